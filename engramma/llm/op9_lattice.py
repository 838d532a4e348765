"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to eight dimensions in several tables (random orthonormal
rows), scaled, and decoded to the nearest point of the E8 lattice.  A vector is kept in its own cell
and looks into the nearest neighbouring cells too.

1. Cells.  An entry of a cell is an id, a mark of its owners and a sketch of `SKETCH` signs of
   random projections; no vector is shuffled here, and entries travel in packed arrays.  In a cell,
   pairs of which one owns it and whose sketches are near enough (4.5 standard deviations beyond what the
   threshold leads to expect) are candidates; only a spanning forest of them leaves the cell.
2. Groups.  The candidates' components are groups; each vector of a group of two or more is brought to its group once.
3. Check.  Within a group all cosines are taken in double precision, so links are exact for
   every pair the lattice brought into one group; counts and a spanning forest come back.

Vectors that are equal in all components are one class (128 bits of hash), compared once and weighted by its
number of rows.  Buckets of cells, and groups beyond `TILE` members, that are too large for a task are
cut into tiles, and every pair of tiles is compared, so a hot cell is no single task and nothing is capped.

Cost: entries are rows x tables x (1 + probes) x 28 bytes, and vectors without likeness that share a cell are compared by sketch. A finer lattice has fewer of these and needs more
tables and probes for the same recall; `Lattice.for_rows` weighs the two for the table's number of vectors (from 3 tables at a million to 12 at a billion; recall above 0.97 at a cosine of 0.951 for each).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (kept, component of their own); vectors of different
lengths never link, and long ones only make rows longer; repeated rows (same vec_id) count as vectors of their own and
give repeated rows; null vec_id is kept as null, links as others do, and is named by
the component's smallest id that isn't null (null if there is none); other columns are ignored and never clash;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.llm.common import U64, bounded_batches, mix, scratch, shuffle_parts, store
from engramma.llm.components import components, forest

TILE = 1024
SKETCH = 128
BUCKET = 1 << 18  # entries of a bucket of cells; beyond four times that it is cut into tiles
ENTRY = np.dtype([("cell", "<u4"), ("id", "<i8"), ("s0", "<u8"), ("s1", "<u8")])  # the cell's top bit: owner


#: Tables, probes and scale, from small tables to large ones; what an entry costs, in comparisons of two sketches.
SETTINGS, ENTRY_COST = ((3, 6, 6.0), (4, 12, 8.0), (6, 24, 10.0), (8, 32, 12.0), (12, 48, 14.0)), 500


@dataclass(frozen=True)
class Lattice:
    tables: int = 3
    probes: int = 6
    scale: float = 6.0
    seed: int = 20

    def unlike(self) -> float:
        """Share of a table's vectors that a vector without likeness to them meets in a cell: (pi scale**2 / 16)**-4 a table and look."""
        return (math.pi * self.scale**2 / 16) ** -4 * self.tables * (1 + 2 * self.probes)

    @classmethod
    def for_rows(cls, n: int) -> Lattice:
        """Of settings with a measured recall above 0.97 at a cosine of 0.951, the one of least cost for n vectors: entries are shuffled, vectors that meet are compared."""
        return min((cls(*x) for x in SETTINGS), key=lambda c: ENTRY_COST * c.tables * (1 + c.probes) + n * c.unlike())


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the closer of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def projection(dim: int, cfg: Lattice, table: int) -> np.ndarray:
    rng = np.random.default_rng([cfg.seed, table, dim])
    rows = rng.normal(size=(8, max(dim, 8)))[:, :dim] if dim < 8 else np.linalg.qr(rng.normal(size=(dim, 8)))[0].T
    return rows * (cfg.scale * np.sqrt(dim / 64))


def _key(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    out = np.full(points.shape[:-1], U64(table * 1_000_003 + dim * 7 + 1))
    for k in range(8):
        out = mix(out ^ (2 * points[..., k]).astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15))
    return out


def cells(unit: np.ndarray, cfg: Lattice) -> np.ndarray:
    """Cell keys (n, tables, 1 + probes): the own cell first, then the nearest of its neighbours."""
    n, dim = unit.shape
    out = np.empty((n, cfg.tables, 1 + cfg.probes), U64)
    for t in range(cfg.tables):
        flat = unit @ projection(dim, cfg, t).T
        home = decode(flat)
        # distance to home + root, less what is the same for all roots
        order = np.argpartition(-((flat - home) @ ROOTS.T), cfg.probes, axis=1)[:, : cfg.probes] if cfg.probes else np.zeros((n, 0), int)
        out[:, t, 0] = _key(home, t, dim)
        out[:, t, 1:] = _key(home[:, None, :] + ROOTS[order], t, dim)
    return out


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """(n, 2) words: signs of random projections."""
    planes = np.random.default_rng([seed, unit.shape[1], 999]).normal(size=(unit.shape[1], SKETCH)).astype(np.float32)
    return np.packbits(unit.astype(np.float32) @ planes > 0, axis=1).view("<u8")


def sketch_bound(threshold: float) -> int:
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return max(4, math.ceil(SKETCH * p + 4.5 * math.sqrt(SKETCH * p * (1 - p))))


def vectors_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All components of an Arrow list column, and the borders of its rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def by_length(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
    """For each length: the rows that have it, and their unit vectors in double precision."""
    sizes = np.diff(offsets)[rows]
    for dim in np.unique(sizes):
        pick = rows[sizes == dim]
        x = values[offsets[pick][:, None] + np.arange(dim)].astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        yield pick, x / np.sqrt((x * x).sum(1, keepdims=True))


def sound_rows(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (null if it can't link) and two hashes of v."""
    inner = rows.schema[vec_col].dataType.elementType
    kind = "float" if isinstance(inner, T.FloatType) else "double"
    wide = F.transform(F.col(vec_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0 becomes 0
    sound = F.coalesce(F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(wide, lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, wide).alias("v"))
    hashed = lambda *c: F.when(F.col("v").isNotNull(), F.xxhash64(*c))
    return base.select("vec_id", "v", hashed(F.col("v")).alias("a"), hashed(F.lit(1), F.col("v")).alias("b"))


def candidates(sound: DataFrame, n: int, threshold: float, cfg: Lattice) -> DataFrame:
    """Edges (u, v) of hashes `a` that span all pairs of like sketches which meet in a cell."""
    spark = sound.sparkSession
    buckets = max(64, math.ceil(n * cfg.tables * (1 + cfg.probes) / BUCKET))
    bound = sketch_bound(threshold)

    def placed(batches: Iterator):
        """Buckets and entries of up to about BUCKET entries at a time, in order of buckets."""
        held, size = [], 0

        def flush():
            place, entry = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(place, kind="stable")
            return place[order], entry[order]

        for batch in batches:
            values, offsets = vectors_of(batch.column("v"))
            ids, first = np.unique(batch.column("a").to_numpy(), return_index=True)
            back = dict(zip(first.tolist(), ids.tolist(), strict=True))
            for pick, unit in by_length(values, offsets, np.sort(first)):
                key = cells(unit, cfg)
                entry = np.empty(key.shape, ENTRY)
                entry["cell"] = (key >> U64(33)).astype(np.uint32)  # 31 bits
                entry["cell"][:, :, 0] |= np.uint32(1 << 31)
                entry["id"] = np.array([back[i] for i in pick.tolist()])[:, None, None]
                word = sketches(unit, cfg.seed)
                entry["s0"], entry["s1"] = word[:, 0, None, None], word[:, 1, None, None]
                held.append((((key & U64((1 << 33) - 1)) % U64(buckets)).astype(np.int64).ravel(), entry.ravel()))
                size += entry.size
                if size >= BUCKET:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for place, _ in placed(batches):
            bucket, times = np.unique(place, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(times)], ["bucket", "n"])

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for place, entry in placed(batches):
            bucket, at = np.unique(place, return_index=True)
            raw = [x.tobytes() for x in np.split(entry, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(raw, pa.binary())], ["bucket", "data"])

    def tiled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["bucket", "lo", "hi", "tile", "data"]
        for batch in batches:
            out = []
            for bucket, tiles, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tiles", "data")), strict=True):
                if tiles is None:
                    out.append((bucket, 0, 0, 0, data))
                    continue
                entry = np.frombuffer(data, ENTRY)
                mine = (mix(entry["id"].view(U64)) % U64(tiles)).astype(np.int64)
                for t in np.unique(mine).tolist():
                    raw = entry[mine == t].tobytes()
                    out += [(bucket, min(t, u), max(t, u), t, raw) for u in range(tiles)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    def compare(key, table):
        import pyarrow as pa

        parts = [np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("data")]
        tile = np.repeat(table.column("tile").to_numpy(), [len(p) for p in parts])
        edges = near_sketches(np.concatenate(parts), tile, key[1].as_py() != key[2].as_py(), bound)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    vectors = bounded_batches(sound.select("a", "v"))
    sizes = vectors.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    over = store(sizes.where(F.col("n") > 4 * BUCKET).select("bucket", F.ceil(F.col("n") / BUCKET).alias("tiles")))
    entries = vectors.mapInArrow(send, "bucket long, data binary").join(over, "bucket", "left")
    units = entries.select("bucket", "tiles", "data").mapInArrow(tiled, "bucket long, lo long, hi long, tile long, data binary")
    units = units.repartition(max(shuffle_parts(spark), math.ceil(buckets / 16)), "bucket", "lo", "hi")
    return units.groupBy("bucket", "lo", "hi").applyInArrow(compare, "u long, v long")


def near_sketches(entry: np.ndarray, tile: np.ndarray, across: bool, bound: int) -> np.ndarray:
    """Edges (n, 2) between ids that span the pairs of like sketches in each cell; `across`: only of different tiles."""
    cell, own = entry["cell"] & np.uint32((1 << 31) - 1), entry["cell"] >> np.uint32(31) != 0
    order = np.lexsort((~own, entry["id"], cell))
    cell, own, ids, tile = cell[order], own[order], entry["id"][order], tile[order]
    new = np.append(True, (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1]))  # repeated rows of other batches
    cell, own, ids, tile = cell[new], own[new], ids[new], tile[new]
    s0, s1 = entry["s0"][order][new], entry["s1"][order][new]
    edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
    size = np.diff(edge)
    found: list[np.ndarray] = []
    waiting = 0

    def keep(x, y):
        nonlocal found, waiting
        if len(x):
            found.append(np.stack([ids[x], ids[y]], 1))
            waiting += len(x)
            if waiting > 1 << 20:
                all_ = np.concatenate(found)
                found, waiting = [np.array(forest(all_[:, 0], all_[:, 1])).reshape(-1, 2)], 0

    small = np.repeat(size <= 24, size)
    for d in range(1, min(24, len(cell))):  # entries d places apart in small cells
        i = np.flatnonzero(small[: len(cell) - d] & (cell[d:] == cell[:-d]) & (own[d:] | own[:-d]) & (not across or tile[d:] != tile[:-d]))
        j = i + d
        near = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int16) + np.bitwise_count(s1[i] ^ s1[j]) <= bound
        keep(i[near], j[near])
    for k in np.flatnonzero(size > 24).tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        step = max(1, (1 << 20) // (b - a))
        for i in range(a, b, step):
            rows = np.arange(i, min(i + step, b))
            right = np.arange(i, b)
            near = np.bitwise_count(s0[rows][:, None] ^ s0[right][None, :]) + np.bitwise_count(s1[rows][:, None] ^ s1[right][None, :]).astype(np.int16) <= bound
            near &= (own[rows, None] | own[None, right]) & (rows[:, None] < right[None, :])
            if across:
                near &= tile[rows, None] != tile[None, right]
            x, y = np.nonzero(near)
            keep(rows[x], right[y])
    all_ = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.array(forest(all_[:, 0], all_[:, 1]), np.int64).reshape(-1, 2) if len(all_) else all_


def group_links(members: DataFrame, threshold: float) -> DataFrame:
    """Per member (num): rows (a, b null, n) with counts of linked rows, and forest edges (a, b), over members (num, root, weight, v)."""
    spark = members.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("all")).where(F.col("all") > TILE)
    sizes = store(sizes.select("root", F.ceil(F.col("all") / TILE).cast("int").alias("tiles")))
    units = members.select("num", "root", "weight", "v").join(sizes, "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    units = units.withColumn("mine", F.pmod(F.xxhash64("num"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = units.select("num", "root", "weight", "v", F.col("mine").alias("tile"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "tiles")
    # small groups share a task, by their number; a tile pair of a large group has a task of its own
    tasks = max(shuffle_parts(spark), math.ceil(members.count() / (4 * TILE)))
    task = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "lo", "hi"))

    def compare(key, table):
        import pyarrow as pa

        count: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        table = table.combine_chunks()
        num, root, lo, hi, tile, weight = (table.column(c).to_numpy() for c in ("num", "root", "lo", "hi", "tile", "weight"))
        values, offsets = vectors_of(table.column("v").chunk(0))
        order = np.lexsort((tile, hi, lo, root))
        cut = np.flatnonzero((root[order][1:] != root[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])) + 1
        for rows in np.split(order, cut):
            if len(rows) < 2:
                continue
            for pick, unit in by_length(values, offsets, rows):
                for x, y in linked(unit, tile[pick], bool(lo[rows[0]] != hi[rows[0]]), threshold):
                    for here, there in ((x, y), (y, x)):
                        got = np.bincount(here, weight[pick][there], minlength=len(pick))
                        for k in np.flatnonzero(got).tolist():
                            count[int(num[pick[k]])] = count.get(int(num[pick[k]]), 0) + int(got[k])
                    edges.extend((int(num[pick[p]]), int(num[pick[q]])) for p, q in forest(x, y))
        a = [*count, *(x for x, _ in edges)]
        b = [None] * len(count) + [y for _, y in edges]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*count.values(), *[0] * len(edges)], pa.int64())], ["a", "b", "n"])

    return units.withColumn("task", task).groupBy("task").applyInArrow(compare, "a long, b long, n long")


def linked(unit: np.ndarray, tile: np.ndarray, across: bool, threshold: float):
    """Pairs (x, y) of rows with a cosine of `threshold` or more, in blocks; `across`: of different tiles."""
    for i in range(0, len(unit), 512):
        rows = np.arange(i, min(i + 512, len(unit)))
        right = np.arange(i, len(unit))
        ok = (unit[rows] @ unit[right].T >= threshold) & (rows[:, None] < right[None, :])
        if across:
            ok &= tile[rows][:, None] != tile[right][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield rows[x], right[y]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, cfg: Lattice | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    with scratch(rows.sparkSession) as keep:
        all_ = sound_rows(rows, id_col, vec_col)
        sound = all_.where("v is not null")
        keyed = keep(store(all_.select("vec_id", "a", "b")))
        classes = keyed.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
        n = keyed.where("a is not null").count()
        met = store(candidates(sound, n, threshold, cfg or Lattice.for_rows(n)))
        groups = components(met)
        grouped = sound.join(groups, F.col("a") == F.col("node")).groupBy("root", "a", "b").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
        members = store(grouped.withColumn("num", F.monotonically_increasing_id()))  # written once, so the numbers stand
        found = store(group_links(members, threshold))
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "m")
        named = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
        per = members.select("num", "a", "b", "least").join(counts, F.col("num") == F.col("m"), "left").join(named.withColumnRenamed("root", "head"), F.col("num") == F.col("node"), "left")
        per = per.select("a", "b", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("head", "num").alias("head"))
        best = per.groupBy("head").agg(F.min("least").alias("component_id"))
        per = store(per.join(best, "head").select("a", "b", "n", "component_id", F.lit(True).alias("in_group")))
        per = classes.join(per, ["a", "b"], "left")
        comp = F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("least"))
        per = keep(store(per.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), comp.alias("component_id"))))
    out = keyed.join(per, ["a", "b"], "left")
    comp = F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(comp == F.col("vec_id"), F.col("vec_id").isNull() & comp.isNull())
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), kept.alias("kept"))


def op9_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
