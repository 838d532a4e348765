"""Token counts of documents in flat, unindexed token files by a separator scan.

A token file is a run of fixed-width ids in which an end-of-document id closes each
document; there is no index.  Files are read in ranges, a block each; every block is searched for the
separator in numpy, and gives its size, its separators and the place of its last one.
A prefix scan over the blocks of a file (sums of sizes and separators, running maximum
of the last separator's place) then stitches documents that cross block borders.  The scan
has two levels: within `SUPER` blocks, and over the totals of those, so a single huge
file is no single task anywhere.

`flat_blocks` makes such files from documents with a real vocabulary (16-bit ids of the transducer of `op2_bpe`, end id 65535): each
partition of the table writes one flat run of ids, cut into blocks with no regard to documents; nothing is shuffled,
and a document repeated in many rows stays where it is.  Beside a block go the doc_ids of the documents that close in it.

Defined cases: two separators in a row bound an empty document (0 tokens); tokens behind the last
separator of a file are one open document (`closed` false); an empty file has no
documents; a file whose size is no multiple of the id's width raises an error. In `flat_blocks`, null or empty text is an empty document, null doc_id stays
null, repeated rows are documents of their own, a text of any length goes piece by piece, an empty table gives no rows and
other columns are ignored and never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramma.llm import op2_bpe
from engramma.llm.common import bounded_batches, drop_stored, shuffle_parts, store

BLOCK_TOKENS = 1 << 15
SUPER = 1024
END = 65535


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload) of flat token files of any size. The listing is Spark's; executors open each file at a block's offset
    (any URI that `pyarrow.fs` can open), so no row holds more than a block."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    size = block_tokens * width
    ranges = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        held: tuple = (None, None)
        for batch in batches:
            for file, length, block in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "block")), strict=True):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are no whole number of {width}-byte ids")
                if held[0] != file:
                    if held[1] is not None:
                        held[1].close()
                    system, inner = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                    held = file, system.open_input_file(inner)
                raw = held[1].read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], ["file", "block", "payload"])

    spread = ranges.repartition(shuffle_parts(spark), "file", F.floor(F.col("block") / 64))  # neighbours share a reader
    return spread.mapInArrow(read, "file string, block long, payload binary")


def separators(rows: DataFrame, end: int, width: int) -> DataFrame:
    """(file, block, size, ends) and, if given, docs: ends are the places of the separator in each block."""
    kind = {"bigint": "long"}.get(dict(rows.dtypes)["file"], dict(rows.dtypes)["file"])
    named = "docs" in rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dtype = np.dtype(f"<u{width}")
        for batch in batches:
            sizes, found = [], []
            for x in batch.column("payload"):
                tokens = np.frombuffer(x.as_buffer(), dtype)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == end).astype(np.int32))
            cut = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(found)))
            more = ["docs"] if named else []
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int32()), ends, *(batch.column(c) for c in more)], ["file", "block", "size", "ends", *more])

    picked = bounded_batches(rows).select("file", "block", "payload", *(["docs"] if named else [])).where("payload is not null")
    return picked.mapInArrow(run, f"file {kind}, block long, size int, ends array<int>" + (", docs array<long>" if named else ""))


def prefix_scan(found: DataFrame) -> DataFrame:
    """Adds before each block: tokens, separators, and the place in the file of the last separator (-1: none)."""
    own = found.select("file", "block", F.floor(F.col("block") / SUPER).alias("sup"), F.col("size").cast("long").alias("size"), F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    inner = Window.partitionBy("file", "sup").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    inside = own.withColumn("t", zero(F.sum("size").over(inner))).withColumn("d", zero(F.sum("n").over(inner)))
    inside = inside.withColumn("at", F.col("t") + F.col("last")).withColumn("l", F.max("at").over(inner))
    outer = Window.partitionBy("file").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    supers = inside.groupBy("file", "sup").agg(F.sum("size").alias("ts"), F.sum("n").alias("ds"), F.max("at").alias("ls"))
    supers = supers.withColumn("t0", zero(F.sum("ts").over(outer))).withColumn("d0", zero(F.sum("ds").over(outer)))
    supers = supers.withColumn("l0", F.max(F.col("t0") + F.col("ls")).over(outer)).select("file", "sup", "t0", "d0", "l0")
    both = inside.join(supers, ["file", "sup"])
    last = F.coalesce(F.greatest(F.col("t0") + F.col("l"), F.col("l0")), F.lit(-1).cast("long"))
    return both.select("file", "block", (F.col("t0") + F.col("t")).alias("tokens_before"), (F.col("d0") + F.col("d")).alias("docs_before"), last.alias("last_before"))


def count_tokens(rows: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, doc_no, start_token, n_tokens, closed) of every document in blocks (file, block, payload); with `docs` (an id for each
    separator of the block) also doc_id."""
    found = store(separators(rows, end, width))
    named = "docs" in rows.columns
    known = found.join(prefix_scan(found), ["file", "block"])
    each = known.where(F.size("ends") > 0).select("*", F.posexplode("ends").alias("k", "at"))
    begin = F.when(F.col("k") == 0, F.col("last_before")).otherwise(F.col("tokens_before") + F.col("ends")[F.col("k") - 1]) + 1
    doc = [F.col("docs")[F.col("k")].alias("doc_id")] if named else []
    closed = each.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), begin.alias("start_token"), (F.col("tokens_before") + F.col("at") - begin).alias("n_tokens"), F.lit(True).alias("closed"), *doc)
    place = F.max(F.when(F.size("ends") > 0, F.col("tokens_before") + F.element_at("ends", -1)))
    tails = known.groupBy("file").agg(F.max(F.col("tokens_before") + F.col("size")).alias("all"), F.coalesce(place, F.lit(-1).cast("long")).alias("last"), F.sum(F.size("ends")).alias("docs"))
    doc = [F.lit(None).cast("long").alias("doc_id")] if named else []
    tails = tails.where("all - last > 1").select("file", F.col("docs").alias("doc_no"), (F.col("last") + 1).alias("start_token"), (F.col("all") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"), *doc)
    return closed.union(tails)


def flat_blocks(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, payload, docs): flat runs of 16-bit ids of the tokenizer file at `path`, END behind each document, one run for each partition.

    Store the result before it is used twice: the number of a file is its partition's."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), F.spark_partition_id().cast("long").alias("file"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = op2_bpe.tokenizer(path)
        if max(model.texts) >= END:
            raise ValueError("ids don't fit 16 bits")
        size, held, docs, number, file = block_tokens * 2, bytearray(), [], 0, None
        names = ["file", "block", "payload", "docs"]

        def block(payload: bytes, n: int):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary()), pa.array([docs], pa.list_(pa.int64()))], names)

        for batch in batches:
            for doc, text, file in zip(*(batch.column(c) for c in ("doc_id", "body", "file")), strict=True):  # noqa: B020
                file = file.as_py()  # noqa: PLW2901
                for piece in model.pieces(text.as_py()):
                    held += np.frombuffer(b"".join(p[0] for p in piece), "<u4").astype("<u2").tobytes()
                    while len(held) >= size:
                        yield block(bytes(held[:size]), number)
                        del held[:size]
                        docs, number = [], number + 1
                held += b"\xff\xff"
                docs.append(doc.as_py())
                if len(held) >= size:  # the separator filled the block
                    yield block(bytes(held), number)
                    held, docs, number = bytearray(), [], number + 1
        if held:
            yield block(bytes(held), number)

    return rows.mapInArrow(run, "file long, block long, payload binary, docs array<long>")


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = store(flat_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"), op2_bpe.default_path()))
    got = count_tokens(blocks)
    drop_stored(blocks)  # counts read only what the scan stored
    return got.select("doc_id", F.col("file").alias("file_no"), "doc_no", "start_token", "n_tokens", "closed")
