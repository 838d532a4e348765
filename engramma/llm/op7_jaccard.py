"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents are sets of hashed word shingles; equal sets are one class.  Two sets of
Jaccard similarity t or more share an n-gram among the first n - ceil(t n) + 1 of
each, whatever order all n-grams are put in; here those of the rarest words come first
and those that are frequent anywhere last, so columns that unrelated documents share stay
out of the product.  The order needs no exact counts: hashed word counts and a bounded
table of heavy n-grams, counted over all text, are enough, and any table gives the same result.

Each remaining column names a pivot for each band of set sizes, its first document there; (pivot, document) rows are
found by a map-side `min` and a join, so they are linear in the incidence however
many documents share a column.  All documents of one pivot make a row block of the
product.  Blocks beyond `TILE` rows, or `TILE_SHINGLES` shingles, are cut into pairs of row tiles; columns are multiplied in
blocks of `COLUMNS`, overlap counts accumulate, pairs whose sizes rule them out or whose
remaining columns can't reach the bound are discarded, and a block returns only a
spanning forest of its links: pairs are never emitted.

Defined cases: no words, empty or null text: empty set, linked with nothing,
component of its own; one or two words: the sequence is the one shingle. Null doc_id
stays null and takes part; a component is named by its least non-null doc_id (null if there is
none). Repeated rows are equal sets and give a row each; a text goes to a task once, however often it is there. Very long texts
are one set each; an empty table gives no rows. Other columns are ignored and never clash.
Sets are compared by 64-bit hashes of shingles; a class is told by 128 bits of hash of its set, and numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import U64, Block, blocks, bounded_batches, drop_stored, mix, scratch, shuffle_parts, span_hashes, store
from engramma.llm.components import components, forest

TILE, COLUMNS = 512, 8192
TILE_SHINGLES = 1 << 21  # 16 MB of sets
HEAVY = 1 << 18  # bound of the table of heavy n-grams, which is broadcast (about 2.5 MB)
COUNTERS = 1 << 20  # of word counts; their logarithms are broadcast (1 MB)
SLICES = 64
MARKS = 1 << 25  # bits of the tables of shared columns and of wanted texts, which are broadcast (4 MB); a full one only lets more rows through
BAND = 0x9E3779B97F4A7  # times the band's number, in a column's key


def word_slots(words: np.ndarray) -> np.ndarray:
    return (words >> U64(44)).astype(np.int64)


def shingle_sets(block, k: int = 3, levels: np.ndarray | None = None, slots: np.ndarray | None = None):
    """Sorted distinct shingle hashes of each document; A-Z are lower-cased.

    With `levels` (logarithms of word counts) also the sum of its words' levels for each
    shingle, as a list in the same form; `slots` takes counts of the block's words."""
    starts, ends, doc = block.words(lower=True)
    words = span_hashes(block.data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(block.n + 1))
    if slots is not None:
        np.add(slots, np.bincount(word_slots(words), minlength=COUNTERS), out=slots)
    grams, rank = np.zeros(len(words), U64), np.zeros(len(words), np.uint8)
    if len(words) >= k:
        n = len(words) - k + 1
        acc = np.zeros(n, U64)
        for j in range(k):
            acc *= U64(0x9E6C63D0676A9A99)
            acc += words[j : n + j]
        grams[:n] = mix(acc + U64(k))
        if levels is not None:
            own = levels[word_slots(words)]
            for j in range(k):
                rank[:n] += own[j : n + j]
    out, ranks, none = [], [], np.zeros(0, np.uint8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            if levels is None:
                out.append(np.unique(grams[a : b - k + 1]))
            else:
                got, at = np.unique(grams[a : b - k + 1], return_index=True)
                out.append(got)
                ranks.append(rank[a:b][at])
            continue
        if b > a:
            h = np.array([b - a], U64)
            for w in words[a:b]:
                h = mix(h * U64(0xC2B2AE3D27D4EB4F) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
        ranks.append(none if b == a else np.zeros(1, np.uint8))
    return out if levels is None else (out, ranks)


def class_name(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    size = U64(len(s))
    sums = np.array([mix(s + size).sum(dtype=U64), mix(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + size], U64)
    return tuple(mix(sums).view(np.int64).tolist())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    doc = F.col(id_col).cast("long")
    return bounded_batches(docs).select(doc.alias("doc_id"), body.alias("body"), F.xxhash64(doc, body).alias("at"))


def frequencies(rows: DataFrame, k: int, least: int = 3, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all text: the most frequent shingles (at most HEAVY, sorted) with logarithms of their counts,
    and logarithms of word counts by hashed slot."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        held, size, slots = [], 0, np.zeros(COUNTERS, np.int64)
        names = ["gram", "n", "part", "data"]
        none = lambda n, kind: pa.nulls(n, kind)

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= least
            m = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often]), none(m, pa.int32()), none(m, pa.binary())], names)

        for batch in batches:
            for block in blocks(batch.column("body")):
                for s in shingle_sets(block, k, slots=slots):
                    held.append(s)
                    size += len(s)
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if slots.any():
            press = zstandard.ZstdCompressor(level=1)
            data = pa.array([press.compress(x.tobytes()) for x in np.split(slots, SLICES)], pa.binary())
            yield pa.RecordBatch.from_arrays([none(SLICES, pa.int64()), none(SLICES, pa.int64()), pa.array(np.arange(SLICES), pa.int32()), data], names)

    def add(key, frame):
        import pandas as pd
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for raw in frame["data"]:
            total += np.frombuffer(open_.decompress(raw), np.int64)
        return pd.DataFrame({"part": [key[0]], "data": [np.log2(1.0 + total).round().astype(np.uint8).tobytes()]})

    counted = store(rows.select("body").mapInArrow(count, "gram long, n long, part int, data binary"))
    got = counted.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HEAVY).toPandas()
    grams, n = got["gram"].to_numpy(np.int64).view(U64), got["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    levels = np.zeros(COUNTERS, np.uint8)
    width = COUNTERS // SLICES
    for r in counted.where("part is not null").select("part", "data").groupBy("part").applyInPandas(add, "part int, data binary").collect():  # SLICES rows, 1 MB in all
        levels[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["data"], np.uint8)
    drop_stored(counted)
    return grams[order], (1 + np.log2(np.maximum(n[order], 1))).astype(np.uint8), levels


def features(rows: DataFrame, k: int, percent: int, known) -> DataFrame:
    """Per row: set size, class, and the n-grams of its prefix."""
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grams, level, levels = table.value
        for batch in batches:
            for block in blocks(batch.column("body")):
                sets, ranks = shingle_sets(block, k, levels)
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                rank = np.minimum(np.concatenate(ranks) if ranks else np.zeros(0, np.uint8), 95).astype(U64)
                if len(grams):  # heavy n-grams come after all others
                    at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
                    rank = np.where(grams[at] == flat, U64(96) + level[at].astype(U64), rank)
                order_key = (rank << U64(56)) | (flat >> U64(8))
                prefix, at = [], 0
                for s in sets:
                    n = len(s)
                    p = n - (percent * n + 99) // 100 + 1 if n else 0
                    prefix.append(s[np.argsort(order_key[at : at + n], kind="stable")[:p]].view(np.int64))
                    at += n
                cut = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                ids, key = (batch.column(c).slice(block.first, block.n) for c in ("doc_id", "at"))
                node, twin = (pa.array(x, pa.int64()) for x in zip(*map(class_name, sets), strict=True))
                yield pa.RecordBatch.from_arrays([ids, key, pa.array([len(s) for s in sets], pa.int64()), node, twin, lists], ["doc_id", "at", "n", "node", "twin", "prefix"])

    return rows.select("doc_id", "at", "body").mapInArrow(run, "doc_id long, at long, n long, node long, twin long, prefix array<long>")


def marked(wanted: DataFrame) -> np.ndarray:
    """Bits of the values of the only column, a long, modulo MARKS."""

    def mark(key, table):
        import pyarrow as pa

        bits = np.zeros(MARKS // SLICES, bool)
        bits[table.column("bit").to_numpy() - key[0].as_py() * (MARKS // SLICES)] = True
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    bit = F.pmod(wanted.columns[0], F.lit(MARKS))
    places = wanted.select(bit.alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / (MARKS // SLICES)).cast("int"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in places.groupBy("part").applyInArrow(mark, "part int, bits binary").collect():  # SLICES rows, 4 MB in all
        out[r["part"] * (len(out) // SLICES) : (r["part"] + 1) * (len(out) // SLICES)] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values % MARKS
    return bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 != 0


def shared_cells(classes: DataFrame, marks: np.ndarray) -> DataFrame:
    """(num, at, n, col) of the marked columns of each class (num, at, n, band, prefix), in its own band and the next."""
    sent = classes.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("prefix")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            col, band = lists.flatten().to_numpy(), batch.column("band").to_numpy().astype(np.int64)[row]
            both = np.concatenate([col ^ (band * BAND), col ^ ((band + 1) * BAND)])
            pick = np.flatnonzero(is_marked(sent.value, both))
            at = pa.array(np.concatenate([row, row])[pick])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("num", "at", "n")), pa.array(both[pick])], ["num", "at", "n", "col"])

    return classes.select("num", "at", F.col("n").cast("long").alias("n"), "band", "prefix").mapInArrow(run, "num long, at long, n long, col long")


def squeezed(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """(at, body): marked texts, compressed one by one, which shuffle in half the bytes and in a third of their sets'; a task sends rows of one `at` and length once."""
    sent = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press, seen, bits = zstandard.ZstdCompressor(level=3), set(), sent.value
        for batch in batches:
            at, body = batch.column("at").to_numpy(), batch.column("body")
            out_at, out = [], []
            for i in np.flatnonzero(is_marked(bits, at)).tolist():
                raw = body[i].as_buffer()
                if (key := (int(at[i]), len(raw))) not in seen:
                    seen.add(key)
                    out_at.append(key[0])
                    out.append(press.compress(raw))
            yield pa.RecordBatch.from_arrays([pa.array(out_at, pa.int64()), pa.array(out, pa.binary())], ["at", "body"])

    return rows.select("at", "body").mapInArrow(run, "at long, body binary")


def product(grams: list[np.ndarray], split: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j): i in the first `split` rows, j in the others; all pairs i < j if split is 0."""
    n = np.array([len(g) for g in grams], np.int64)
    left, right = (np.arange(split), np.arange(split, len(n))) if split else (np.arange(len(n)), np.arange(len(n)))
    need = np.maximum(1, -(-percent * (n[left][:, None] + n[right][None, :]) // (100 + percent)))
    open_ = (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])) & (need > 0)
    if not split:
        open_ &= left[:, None] < right[None, :]
    keep = np.zeros(len(n), bool)
    keep[left] |= open_.any(1)
    keep[right] |= open_.any(0)
    if not keep.any():
        return np.zeros(0, int), np.zeros(0, int)
    row = np.repeat(np.arange(len(n)), np.where(keep, n, 0))
    flat = np.concatenate([g for g, k in zip(grams, keep, strict=True) if k])
    cols, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # other columns add nothing to any overlap
    new = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], new[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros(open_.shape, np.float32)
    left_over = np.bincount(row, minlength=len(n))
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(n), min(COLUMNS, int(shared.sum()) - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        overlap += m[left] @ m[right].T
        left_over -= np.bincount(row[a:b], minlength=len(n))
        open_ &= overlap + np.minimum(left_over[left][:, None], left_over[right][None, :]) >= need
        if not open_.any():
            break
    exact = overlap.astype(np.int64)
    ok = open_ & (100 * exact >= percent * (n[left][:, None] + n[right][None, :] - exact))
    i, j = np.nonzero(ok)
    return left[i], right[j]


def link_edges(rows: DataFrame, feats: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) between numbers of classes that span all links, and the classes (node, twin, num)."""
    spark = rows.sparkSession
    classes = feats.where("n > 0").groupBy("node", "twin").agg(F.min(F.struct("at", "n", "prefix")).alias("f")).select("node", "twin", "f.at", "f.n", "f.prefix")
    classes = store(classes.withColumn("num", F.monotonically_increasing_id()))  # written once, so the numbers stand
    # sizes of a linked pair lie in the same or neighbouring bands, so each set goes to its own band and the next
    band = F.floor(F.log("n") / math.log(100 / percent * 1.001)).cast("int")
    banded = classes.select("num", "at", "n", band.alias("band"), "prefix")
    cells = banded.select("at", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "prefix").select("at", "band", F.explode("prefix").alias("col"))
    cells = cells.select("at", F.col("col").bitwiseXOR(F.col("band").cast("long") * F.lit(BAND)).alias("col"))
    pivots = store(cells.groupBy("col").agg(F.min("at").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("col", "pivot"))
    members = store(shared_cells(bounded_batches(banded), marked(pivots.select("col"))).join(pivots, "col").select("pivot", "num", "at", "n").distinct())
    sizes = store(members.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1"))
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.least(F.col("c"), F.ceil(F.col("s") / TILE_SHINGLES))).cast("int")
    units = members.drop("n").join(sizes, "pivot").withColumn("tiles", tiles)
    units = units.withColumn("mine", F.pmod(F.xxhash64("num"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = units.select("pivot", "num", "at", "tiles", F.col("mine").alias("tile"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    # small blocks share a task, by their number; a tile pair of a large block has a task of its own
    parts = max(shuffle_parts(spark) * 16, math.ceil(members.count() / TILE))
    units = units.withColumn("task", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("pivot"), F.lit(parts))).otherwise(F.xxhash64("pivot", "lo", "hi"))).drop("tiles")
    units = units.join(classes.select("num", "node", "twin"), "num")
    wanted = members.join(sizes, "pivot", "left_semi").select("at").distinct()
    texts = squeezed(rows, marked(wanted)).dropDuplicates(["at", "body"])

    def compare(key, frame):
        import pandas as pd
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        out_u, out_v = [], []
        for (_, lo, hi), g in frame.groupby(["pivot", "lo", "hi"], sort=False):
            g = g.sort_values(["tile", "num"])
            if len(g) < 2:
                continue
            sets = [shingle_sets(Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0), k)[0] for raw in map(open_.decompress, g["body"])]
            right = [class_name(s) == n for s, n in zip(sets, zip(g["node"], g["twin"], strict=True), strict=True)]  # else another text under the same key
            g, grams = g[right], [s for s, ok in zip(sets, right, strict=True) if ok]
            node = g["num"].to_numpy()
            split = 0 if lo == hi else int((g["tile"] == lo).sum())
            if len(g) < 2 or lo != hi and split in (0, len(g)):
                continue
            x, y = product(grams, split, percent)
            if len(x):
                for a, b in forest(x, y):
                    out_u.append(int(node[a]))
                    out_v.append(int(node[b]))
        return pd.DataFrame({"u": pd.Series(out_u, dtype="int64"), "v": pd.Series(out_v, dtype="int64")})

    edges = store(units.join(texts, "at").groupBy("task").applyInPandas(compare, "u long, v long"))
    drop_stored(members, sizes, pivots)
    return edges, classes


def classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Features of all rows, and for each class its component's least doc_id and the key (`at`, of doc_id and text) of its first document."""
    rows = _rows(docs, id_col, text_col)
    with scratch(docs.sparkSession) as keep:
        feats = keep(store(features(rows, k, percent, frequencies(rows, k))))
        edges, classes = link_edges(rows, feats, k, percent)
        named = components(edges)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
        base = feats.where("n > 0").groupBy("node", "twin").agg(F.min("doc_id").alias("least"), first.alias("first")).join(classes.select("node", "twin", "num"), ["node", "twin"])
        base = base.join(named.withColumnRenamed("node", "m"), F.col("num") == F.col("m"), "left").select("node", "twin", "least", "first", F.coalesce("root", "num").alias("root"))
        base = store(base)
        best = store(base.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first")))
        return feats, keep(store(base.select("node", "twin", "root").join(best, "root").select("node", "twin", "component_id", F.col("first.at").alias("keep"))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    feats, per = classified(docs, id_col, text_col, k, percent)
    out = feats.select("doc_id", "n", "node", "twin").join(per, ["node", "twin"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """`docs` less all rows of each component but one, the first by doc_id; rows without a word stay.

    Documents are told by doc_id and text, so other texts under the same doc_id are not touched; of rows equal
    in both, one stays: the least by all columns as JSON, which orders columns of any type, maps and variants too."""
    feats, per = classified(docs, id_col, text_col, k, percent)
    worded = feats.where("n > 0").select("node", "twin", "doc_id", "at")
    ident = lambda doc, at: F.struct(doc.alias("doc"), at.alias("at"))
    named = worded.join(per, ["node", "twin"]).select(ident(F.col("doc_id"), F.col("at")).alias("_g"), (F.col("at") != F.col("keep")).alias("later"))
    gone = store(named.where("later").select("_g").distinct())
    twice = store(named.where("not later").groupBy("_g").agg(F.count("*").alias("c")).where("c > 1").select("_g"))
    drop_stored(feats, per)
    doc = F.col(f"_d.{id_col}").cast("long")
    rows = docs.select(F.struct("*").alias("_d")).withColumn("_k", ident(doc, F.xxhash64(doc, F.coalesce(F.col(f"_d.{text_col}").cast("binary"), F.lit(b"")))))
    rows = rows.join(gone, F.col("_k").eqNullSafe(F.col("_g")), "left_anti")
    once = rows.join(twice, F.col("_k").eqNullSafe(F.col("_g")), "left_anti").select("_d")
    first = rows.join(twice, F.col("_k").eqNullSafe(F.col("_g")), "left_semi").groupBy("_k").agg(F.min_by("_d", F.to_json("_d")).alias("_d")).select("_d")
    return once.union(first).select(*[F.col("_d")[c].alias(c) for c in docs.columns])


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
