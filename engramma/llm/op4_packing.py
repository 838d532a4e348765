"""Variable-capacity best-fit packing.

Pieces of documents are packed into sequences of several permitted lengths.  Per
group of about `GROUP` documents, pieces go by decreasing length to the open bin they fill best.  A piece that
fits none opens a bin, whose size is chosen for this bin: for each permitted length that holds the piece,
the bin is filled on trial with the largest pieces still to come that fit, and the length with the least final
cost per token (of the bin downsized to what the trial put in) is opened.  Each finished bin is downsized to the smallest
permitted length that holds its contents.  Openings of one size throughout are packed as well, and
the cheapest packing of a group stands, so choosing bin by bin never costs more.

Only ids and lengths are shuffled, never texts.  Groups come from a hash of
document, length and number of the copy, so a document repeated in many rows is
spread over groups; their number follows the number of rows, and a group wastes at
most its last open bins.

Lengths are UTF-8 bytes (byte-level tokens) unless another length column is given.
Defined cases: a text longer than the largest size is cut into full pieces and a
rest; null or empty text is one piece of length 0; null `doc_id` is kept; repeated
rows are numbered by `copy`; other columns are ignored and never clash; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, copy long, piece long, piece_start long, piece_len long, bin_id long, bin_offset long, bin_used long, bin_size long"
GROUP = 8192
COPIES = 4096


@dataclass(frozen=True)
class Sizes:
    """Permitted sequence lengths, and what a sequence costs besides its length."""

    lengths: tuple[int, ...] = (2048, 4096, 8192, 16384)
    overhead: int = 128

    def cost(self, length: int) -> int:
        return length + self.overhead

    def least(self, need: int) -> int:
        return min((c for c in self.lengths if c >= need), key=self.cost)


def best_fit(lengths: list[int], sizes: Sizes, opened: int | None = None) -> list[list[int]]:
    """Bins (lists of indices) by best-fit decreasing; a new bin's size is `opened` where that holds the piece, or, if not given, chosen for the bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]
    room: list[tuple[int, int]] = []  # free space and bin, ascending
    bins: list[list[int]] = []
    for k, i in enumerate(order):
        need = lengths[i]
        at = bisect.bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = cheapest(falling, k, sizes) if opened is None else opened
            free, b = size if size >= need else sizes.least(need), len(bins)
            bins.append([])
        bins[b].append(i)
        bisect.insort(room, (free - need, b))
    return bins


def cheapest(falling: list[int], k: int, sizes: Sizes) -> int:
    """The size for a bin that piece k opens: least cost per token, filled on trial with the largest later pieces that fit (`falling`: negative lengths, ascending)."""
    need, best, least = -falling[k], 0, math.inf
    for size in sorted((c for c in sizes.lengths if c >= need), reverse=True):
        used, at = need, k + 1
        while used < size:
            at = bisect.bisect_left(falling, used - size, at)
            if at >= len(falling) or not falling[at]:
                break
            used -= falling[at]
            at += 1
        rate = sizes.cost(sizes.least(used)) / max(used, 1)
        if rate < least:
            best, least = size, rate
    return best


def pack(lengths: list[int], sizes: Sizes = Sizes()) -> list[tuple[int, list[int]]]:
    """The cheapest packing; bins are (downsized length, indices)."""
    best, least = [], math.inf
    for opened in (None, *sorted(sizes.lengths, reverse=True)):
        got = [(sizes.least(sum(lengths[i] for i in b)), b) for b in best_fit(lengths, sizes, opened)]
        cost = sum(sizes.cost(size) for size, _ in got)
        if cost < least:
            best, least = got, cost
    return best


def pack_rows(rows: DataFrame, sizes: Sizes = Sizes(), group: int = GROUP) -> DataFrame:
    """Packing of rows (doc_id, n_tokens)."""
    largest = max(sizes.lengths)
    counted = rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    total = rows.count()
    groups = max(1, math.ceil(total / group))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    runs = counted.select("doc_id", "n_tokens", "copies", upto(F.ceil(F.col("copies") / COPIES)).alias("run"))  # no array grows with the copies
    first = F.col("run") * COPIES
    each = runs.select("doc_id", "n_tokens", first.alias("first"), upto(F.least(F.lit(COPIES), F.col("copies") - first)).alias("nth"))
    each = each.select("doc_id", "n_tokens", (F.col("first") + F.col("nth")).alias("copy"))
    keyed = each.withColumn("grp", F.pmod(F.xxhash64("doc_id", "n_tokens", F.floor(F.col("copy") / 64)), F.lit(groups)))

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values(["doc_id", "n_tokens", "copy"], kind="stable").reset_index(drop=True)
        docs, copies, tokens = frame["doc_id"].tolist(), frame["copy"].tolist(), frame["n_tokens"].tolist()
        n_full = [n // largest if n % largest or not n else n // largest - 1 for n in tokens]
        rest = [n - k * largest for n, k in zip(tokens, n_full, strict=True)]
        out, at = [], int(key[0]) << 24
        for i, full in enumerate(n_full):
            for k in range(full):
                out.append((docs[i], copies[i], k, k * largest, largest, at, 0, largest, largest))
                at += 1
        for size, members in pack(rest, sizes):
            used, offset = sum(rest[i] for i in members), 0
            for i in members:
                out.append((docs[i], copies[i], n_full[i], n_full[i] * largest, rest[i], at, offset, used, size))
                offset += rest[i]
            at += 1
        got = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    return keyed.groupBy("grp").applyInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, sizes: Sizes = Sizes(), id_col: str = "doc_id", length: Column | None = None, text_col: str = "text") -> DataFrame:
    length = F.octet_length(F.col(text_col)) if length is None else length
    return pack_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("n_tokens")), sizes)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
