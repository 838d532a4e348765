"""Versioned snapshots of the store, checkpoints, backups, and readers of logs and conversation sets.

A store is a folder of versions; a small manifest file names the tables of each, so that a
write is all or nothing: tables are written to a fresh folder of their own first, then the manifest is
created, which fails if another writer has made that version meanwhile.

A table is its rows as last written whole, and behind them deltas: changed and new rows, and keys of deleted ones. A change of ten rows writes ten;
reading lays the deltas over the rows, by key, the last one first; `compact` writes the table whole again.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 7
TABLES = ("memories", "links", "facts", "meta", "surprise_counts", "surprise_history")
MEMORIES = (
    "id long, text string, kind string, hv binary, novelty double, importance double, confidence double, strength double, access_count long, created double, "
    "last_access double, consolidated boolean, superseded boolean, dormant boolean, fact_id long, namespace string"
)
LINKS = "src long, dst long, weight double, namespace string, type string, status string, created_at double"
FACTS = "id long, namespace string, fields map<string,string>, hv binary, valid_from double, valid_to double, supersedes long, source string"
META = "namespace string, key string, value string"


COUNTS = "namespace string, context string, token string, count long"
HISTORY = "id long, namespace string, score double"
DECLARED = dict(zip(TABLES, (MEMORIES, LINKS, FACTS, META, COUNTS, HISTORY), strict=True))
#: What a column that an older version lacks is filled with; others become null.
DEFAULTS = {"kind": "episodic", "novelty": 1.0, "importance": 0.5, "confidence": 0.5, "strength": 1.0, "access_count": 0, "consolidated": False, "superseded": False, "dormant": False,
            "type": "lexical", "status": "confirmed", "namespace": "default"}
STATUSES = ("confirmed", "proposed", "rejected")
#: What tells a table's rows apart.
KEYS = {"memories": ["id"], "links": ["src", "dst"], "facts": ["id"], "meta": ["namespace", "key"], "surprise_counts": ["namespace", "context", "token"], "surprise_history": ["namespace", "id"]}
GONE = "_deleted"


def shared(spark: SparkSession) -> str:
    """Folder all executors share; a session may do without the setting only if its executors are this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="engramma-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_place(spark: SparkSession) -> str:
    """A new folder name among those that `scratch` deletes."""
    out = f"{shared(spark).rstrip('/')}/state/{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there, and lost executors cost nothing. `scratch` deletes it."""
    out = fresh_place(df.sparkSession)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is checkpointed inside is deleted at the end, but for the result given to the function it yields: that is written, if it reads any of it.
    If it is much larger than what it reads, `copy=False` lets that stay instead."""
    made: list[str] = []
    stay: list[str] = []
    outer = _MADE.set(made)

    def keep(df: DataFrame, copy: bool = True) -> DataFrame:
        if not copy:
            stay.extend(made)
        elif made:
            df = checkpointed(df)
            stay.append(made[-1])
        return df

    try:
        yield keep
    finally:
        _MADE.reset(outer)
        if (above := _MADE.get()) is not None:
            above.extend(stay)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in made:
            if name not in stay:
                path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(name), True)


def evolved(name: str, df: DataFrame) -> DataFrame:
    """A table as the current schema has it: missing columns with their defaults, states of links that don't exist made `confirmed`; columns of its own stay."""
    want = T.StructType.fromDDL(DECLARED[name])
    here = set(df.columns)
    more = [f for f in want if f.name not in here]
    out = df.select("*", *[F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in more])
    if name == "links":
        status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("confirmed")
        out = out.withColumn("status", status)
    return out


class Store:
    """Snapshots under `root` (any path that Spark can write)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        base = path(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(base)) if fs.exists(base) else []

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def commit(self, base: int | None = None, **tables: DataFrame) -> int:
        """Write the given tables as the version behind `base` (the version that was read; the current one if not given); others
        carry over by reference. If that version exists by then, nothing is changed and an error is raised."""
        def write(manifest: dict, own: str) -> None:
            for name, df in tables.items():
                if name not in TABLES:
                    raise ValueError(name)
                writer = df.write.mode("errorifexists")
                if name == "memories":
                    writer = writer.partitionBy("namespace")
                writer.parquet(f"{own}/{name}")
                manifest["tables"][name] = {"place": f"{own}/{name}", "schema": json.loads(df.schema.json())}

        return self._next(base, write)

    def apply(self, upserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, base: int | None = None, batch: tuple[str, int] | None = None, most: int = 32) -> int | None:
        """Write changed and new rows, and keys of deleted rows, as deltas behind `base`: nothing else is written or read. A table has one change a key at a time.

        `batch` (name of a stream, number) is kept with the version: one that is there already changes nothing, and None is returned. A table with more than `most` deltas is
        written whole in the same version."""
        upserts, deletes = upserts or {}, deletes or {}
        now = (self.current() if base is None else base) or None
        manifest = {} if now is None else self._manifest(now)
        if batch is not None and manifest.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return None

        def write(manifest: dict, own: str) -> None:
            for name in sorted({*upserts, *deletes}):
                keys = KEYS[name]
                gone = deletes[name].select(*keys).distinct().withColumn(GONE, F.lit(True)) if name in deletes else None
                rows = upserts[name].withColumn(GONE, F.lit(False)) if name in upserts else None
                delta = gone if rows is None else rows if gone is None else rows.unionByName(gone, allowMissingColumns=True)
                place = f"{own}/{name}"
                delta.write.mode("errorifexists").parquet(place)
                written = self.spark.read.schema(delta.schema).parquet(place)
                if not written.groupBy(*keys).count().where("count > 1").isEmpty():
                    raise ValueError(f"several changes of one row of {name}")
                entry = dict(manifest["tables"].get(name) or {"place": None, "schema": json.loads(upserts[name].schema.json())})
                entry["deltas"] = [*entry.get("deltas", []), {"place": place, "schema": json.loads(delta.schema.json())}]
                if len(entry["deltas"]) > most:
                    whole = self._read(name, entry, manifest["schema_version"])
                    whole.write.mode("errorifexists").parquet(f"{own}/whole/{name}")
                    entry = {"place": f"{own}/whole/{name}", "schema": json.loads(whole.schema.json())}
                manifest["tables"][name] = entry
            if batch is not None:
                manifest["batches"] = {**manifest.get("batches", {}), batch[0]: batch[1]}

        return self._next(now or 0, write)

    def mutate(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rows of the given keys as `change` makes them, as a delta of as many rows."""
        now = self.current()
        rows = self.table(name, now)
        named = rows.join(keys.select(*KEYS[name]).distinct(), KEYS[name], "left_semi")
        return self.apply({name: change(named).select(*rows.columns)}, base=now)

    def _rows_key(self, manifest: dict) -> str:
        """Tells which rows of memories a version has."""
        entry = manifest["tables"].get("memories", {})
        return "|".join(str(p) for p in (entry.get("place"), *(x["place"] for x in entry.get("deltas", []))))

    def put_index(self, base: int, nodes: DataFrame, links: DataFrame) -> int:
        """Store a navigation index (nodes and links) of the memories of version `base`, as the version behind it."""

        def write(manifest: dict, own: str) -> None:
            nodes.write.parquet(f"{own}/index/nodes")
            links.write.parquet(f"{own}/index/links")
            manifest["index"] = {"place": f"{own}/index", "of": self._rows_key(manifest)}

        return self._next(base, write)

    def index(self, version: int | None = None) -> dict | None:
        """The stored index: `nodes`, `links`, and whether it belongs to this version's rows (`current`)."""
        manifest = self._manifest(version or self.current())
        if (kept := manifest.get("index")) is None:
            return None
        nodes, links = (self.spark.read.parquet(f"{kept['place']}/{name}") for name in ("nodes", "links"))
        return {"nodes": nodes, "links": links, "current": kept["of"] == self._rows_key(manifest)}

    def compact(self, *names: str) -> int | None:
        """Tables with deltas (or those named) written whole; None if none has any."""
        now = self.current()
        able = [name for name, entry in self._manifest(now)["tables"].items() if entry.get("deltas") and (not names or name in names)]
        return self.commit(now, **{name: self.table(name, now) for name in able}) if able else None

    def erase(self, ids: DataFrame) -> int:
        """Delete memories and their links for good: both tables are written whole, and all older versions go, so that no file holds the rows."""
        dead = ids.select(F.col("id").alias("dead")).distinct()
        now = self.current()
        tables = {"memories": self.table("memories", now).join(dead, F.col("id") == F.col("dead"), "left_anti")}
        if "links" in self._manifest(now)["tables"]:
            left = self.table("links", now)
            for end in ("src", "dst"):
                left = left.join(dead, F.col(end) == F.col("dead"), "left_anti")
            tables["links"] = left
        version = self.commit(now, **tables)
        self.vacuum()
        return version

    def _next(self, base: int | None, write: Callable[[dict, str], None]) -> int:
        """The version behind `base`, as `write` changes its manifest with tables in a folder of their own; on any failure the folder goes."""
        last = (self.current() if base is None else base) or None  # 0: nothing was there
        new = (last or 0) + 1
        manifest = {"tables": {}} if last is None else self._manifest(last)
        before, old = {name: t["place"] for name, t in manifest["tables"].items()}, manifest.get("schema_version", SCHEMA_VERSION)
        own = f"{self.root}/data/{uuid.uuid4().hex}"
        try:
            write(manifest, own)
            carried = any(manifest["tables"][name]["place"] == place for name, place in before.items())
            manifest["schema_version"] = min(old, SCHEMA_VERSION) if carried else SCHEMA_VERSION  # tables of an older schema stay told as such
            self._publish(new, json.dumps(manifest))
        except Exception as error:
            fs, path = self._fs()
            fs.delete(path(own), True)
            if isinstance(error, ValueError):
                raise
            raise RuntimeError(f"version {new} was not written: another writer took it, or the folder can't be written") from error
        return new

    def _publish(self, version: int, text: str) -> None:
        """Create the manifest of a version in one step, or fail if there is one: a whole file is linked (local) or renamed (elsewhere) to a name that must be free."""
        fs, path = self._fs()
        jvm = self.spark.sparkContext._jvm
        staged, final = path(f"{self.root}/staged/{uuid.uuid4().hex}"), path(f"{self.root}/manifest/{version}")
        out = fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(path(f"{self.root}/manifest"))
        if fs.getScheme() == "file":
            os.link(staged.toUri().getPath(), final.toUri().getPath())
            fs.delete(staged, False)
        else:
            options = jvm.org.apache.hadoop.fs.Options
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = getattr(options, "Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, final, none)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{version}", wholetext=True).first()[0])

    def _where(self, version: int) -> dict[str, list[str]]:
        """The folders of each table of a version, and of its index."""
        manifest = self._manifest(version)
        places = {name: [p for p in (t["place"], *(x["place"] for x in t.get("deltas", []))) if p] for name, t in manifest["tables"].items()}
        return {**places, "index": [manifest["index"]["place"]]} if "index" in manifest else places

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table with the types it was written with, deltas laid over it, brought to the current schema."""
        manifest = self._manifest(version or self.current())
        return self._read(name, manifest["tables"][name], manifest["schema_version"])

    def _read(self, name: str, entry: dict, schema_version: int) -> DataFrame:
        kind = T.StructType.fromJson(entry["schema"])
        got = self.spark.read.schema(kind).parquet(entry["place"]) if entry["place"] else self.spark.createDataFrame([], kind)
        deltas = None
        for i, delta in enumerate(entry.get("deltas", [])):
            one = self.spark.read.schema(T.StructType.fromJson(delta["schema"])).parquet(delta["place"]).withColumn("_delta", F.lit(i))
            deltas = one if deltas is None else deltas.unionByName(one, allowMissingColumns=True)
        if deltas is not None:
            columns = [c for c in deltas.columns if c not in (GONE, "_delta")]
            last = deltas.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS[name]]).agg(F.max_by(F.struct(*columns, GONE), "_delta").alias("_row"))
            same = [got[k] == F.col(f"_{k}") for k in KEYS[name]]
            got = got.join(last.drop("_row"), same, "left_anti").unionByName(last.where(f"not _row.{GONE}").select(*[F.col("_row")[c].alias(c) for c in columns]), allowMissingColumns=True)
        return evolved(name, got) if schema_version < SCHEMA_VERSION else got

    def migrate(self) -> int | None:
        """Write the tables of an older schema as a version of the current one; the old version stays until vacuumed. None if there is nothing to do."""
        now = self.current()
        if now is None or self._manifest(now)["schema_version"] >= SCHEMA_VERSION:
            return None
        return self.commit(now, **{name: self.table(name, now) for name in self._manifest(now)["tables"]})

    def rollback(self, version: int) -> None:
        fs, path = self._fs()
        for v in self.versions():
            if v > version:
                fs.delete(path(f"{self.root}/manifest/{v}"), True)

    def vacuum(self) -> int:
        """Delete data of versions that the current one doesn't use, and older manifests."""
        fs, path = self._fs()
        now = self.current()
        used = {place for places in self._where(now).values() for place in places}
        dropped = 0
        for v in self.versions():
            if v < now:
                for place in (p for places in self._where(v).values() for p in places):
                    if place not in used and fs.exists(path(place)):
                        fs.delete(path(place), True)
                        dropped += 1
                fs.delete(path(f"{self.root}/manifest/{v}"), True)
        return dropped

    def backup(self, target: str) -> int:
        """Copy of the current version into another store, counted against the source."""
        other = Store(self.spark, target)
        tables = {name: self.table(name) for name in self._manifest(self.current())["tables"]}
        version = other.commit(**tables)
        for name, df in tables.items():
            if df.count() != other.table(name, version).count():
                raise RuntimeError(f"backup of {name} is not whole")
        return version

    def restore(self, source: str) -> int:
        """Bring a backup back as a new version; the old one stays until vacuumed."""
        other = Store(self.spark, source)
        return self.commit(**{name: other.table(name) for name in other._manifest(other.current())["tables"]})

    def health(self) -> dict:
        """Whether the current version can be read with its schema and the folder written (tried with a file)."""
        now = self.current()
        if now is None:
            return {"ok": False, "reason": "empty"}
        manifest = self._manifest(now)
        counts, lacking = {}, {}
        for name in manifest["tables"]:
            table = self.table(name, now)
            counts[name] = table.count()
            missing = {f.name for f in T.StructType.fromDDL(DECLARED[name])} - set(table.columns)
            if missing and name != "memories" or missing - {"hv", "novelty", "fact_id"}:
                lacking[name] = sorted(missing)
        fs, path = self._fs()
        probe = path(f"{self.root}/probe-{uuid.uuid4().hex}")
        try:
            fs.create(probe, False).close()
            writable = bool(fs.delete(probe, False))
        except Exception:  # noqa: BLE001 - the answer is what is asked for
            writable = False
        return {"ok": writable and not lacking, "version": now, "schema_version": manifest["schema_version"], "rows": counts, "lacking": lacking, "writable": writable}


def write_json(views: dict[str, DataFrame], folder: str) -> None:
    """Views (list, graph, facts, status, tokens, log, ...) as folders of JSON lines, an object a row; nulls are written too."""
    for name, df in views.items():
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{folder.rstrip('/')}/{name}")


def write_text(lines: DataFrame, folder: str) -> None:
    """One column of lines as text, in order of line_no: files follow one another by name."""
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.col("line").alias("value"))
    ordered.write.mode("errorifexists").text(folder)


SESSIONS = "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Conversation sets in JSON: a row for each turn, with whether its session holds the answer."""
    raw = spark.read.schema(SESSIONS).json(path, multiLine=True)
    bad = raw.where("question_id is null or question is null or size(haystack_session_ids) <> size(haystack_sessions)").limit(1).count()
    if bad:
        raise ValueError("not a conversation set")
    each = raw.select("question_id", "question", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    turns = each.select("question_id", "question", F.col("s.haystack_session_ids").alias("session_id"), F.array_contains("answer_session_ids", F.col("s.haystack_session_ids")).alias("holds_answer"), F.posexplode("s.haystack_sessions").alias("turn", "m"))
    return turns.select("question_id", "question", "session_id", "holds_answer", "turn", "m.role", F.col("m.content").alias("text"), F.col("question_id").endswith("_abs").alias("unanswerable"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Decision log: (line, ts, action, detail)."""
    return parse_log(spark.read.text(path))


def parse_log(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    return lines.select(v.alias("line"), F.substring(v, 1, 19).alias("ts"), F.substring_index(F.substring(v, 21, 1_000_000), " ", 1).alias("action"), F.trim(F.substring(v, 31, 1_000_000)).alias("detail"))
