"""Shared pieces of the corpus operators: shared-folder storage and byte-level text blocks.

Text columns travel to Python as Arrow binary arrays, so numpy sees the UTF-8
bytes of a batch without building Python strings.  Blocks are cut at document
borders (or inside one very long document, at word borders) so that memory is
bounded by the block size and not by the batch.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: `spark.checkpoint.dir`. Only a session whose executors are this process may do without: it gets one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="engramma-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def store(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives a plain scan below later joins, so that adaptive execution may split skewed keys."""
    spark = df.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/engramma/{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(out)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those given to the function it yields."""
    made: list[str] = []
    kept: list[DataFrame] = []
    outer = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _MADE.reset(outer)
        stay = {name for df in kept for file in df.inputFiles() for name in made if name.rsplit("/", 1)[1] in file}
        if (above := _MADE.get()) is not None:
            above.extend(stay)  # an outer scratch sees to them
        for name in made:
            if name not in stay:
                _delete(spark, name)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables written by `store` that no later step reads."""
    for df in frames:
        for name in df.inputFiles()[:1]:
            if "/engramma/" in name:
                _delete(df.sparkSession, name.rsplit("/", 1)[0])


BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, so that workers' memory does not follow text length.

    These are settings of the session, read when a plan runs, after the operator has returned: they stay as set here (a smaller value of the caller's stays too)."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = _number(conf.get(key))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return docs


def _number(value: str) -> int:
    digits = "".join(c for c in value if c.isdigit() or c == "-")
    unit = {"k": 10, "m": 20, "g": 30}.get(value.lower().rstrip("b")[-1:], 0)
    return int(digits or 0) << unit if int(digits or 0) > 0 else -1


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names: extra columns never clash."""
    return bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )


# ---------------------------------------------------------------- bytes of a batch

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


mix = _mixed
_LENGTH = U64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a sum, over its eight-byte words, of a mix keyed by the word's place; spans are ascending and disjoint.

    Each word goes through the mix before it is added, so no pattern of bytes cancels out, as it may in a polynomial modulo 2**64."""
    out = np.empty(len(starts), U64)
    at = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the word from each byte on
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, int(starts[i]) + BLOCK_BYTES, "right")))
        size = ends[i:j] - starts[i:j]
        words = np.maximum(1, (size + 7) >> 3)
        first = np.cumsum(words) - words
        place = np.arange(int(words.sum())) - np.repeat(first, words)
        left = np.minimum(np.repeat(size, words) - 8 * place, 8)
        word = at[np.repeat(starts[i:j], words) + 8 * place] & _MASK[left]
        key = _mixed(np.arange(1, int(words.max()) + 1, dtype=U64))
        out[i:j] = np.add.reduceat(_mixed(word ^ key[place]), first) + size.astype(U64) * _LENGTH
        i = j
    return _mixed(out)


class Block:
    """Consecutive documents of a batch: one byte array and their borders in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False, gaps: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document (in the block) of all words: maximal runs of bytes that `gaps` doesn't mark (by default `[^\\x20\\x09-\\x0D]+`)."""
        if lower:
            self.data = _LOWER[self.data]
        gap = gaps[self.data]
        cut = np.ones(len(gap) + 1, bool)
        cut[1:] = np.append(gap[1:], True) if len(gap) else True
        word = ~gap
        border = np.zeros(len(gap) + 1, bool)
        border[self.offsets] = True
        prev_gap = np.empty(len(gap), bool)
        if len(gap):
            prev_gap[0] = True
            prev_gap[1:] = gap[:-1]
        starts = np.flatnonzero(word & (prev_gap | border[:-1]))
        next_gap = np.empty(len(gap), bool)
        if len(gap):
            next_gap[-1] = True
            next_gap[:-1] = gap[1:]
        ends = np.flatnonzero(word & (next_gap | border[1:])) + 1
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        return starts, ends, doc


def blocks(column, block_bytes: int = BLOCK_BYTES):
    """Blocks of a binary or string Arrow column (null: empty), each of whole documents and about `block_bytes`."""
    import pyarrow as pa

    wide = column.type in (pa.large_binary(), pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def per_doc_cumulative(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` in each document."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]
