"""A training-data pipeline of five operators.

Documents that the quality rules reject go; repeated lines are cut; one document of
each group of near copies stays; long repeated byte strings are cut; what is left is packed into
sequences.  Documents that a cut leaves without a word go as well.  Each stage's rows
are written and read again as the next one's documents; all but the last return the
columns of `documents`, with `n_chars` following the text.

Defined cases: rows without text or without a word fail the quality rules. Rows of one doc_id with different texts are
documents of their own in every stage; rows equal in doc_id and text are copies, of which one stays; null doc_ids order last and
stay null. More columns than those of `documents` pass through all stages but the last, whatever their names. Very long texts are
cut nowhere. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm import op1_suffix, op4_packing, op6_quality, op7_jaccard, op8_lines
from engramma.llm.common import drop_stored, store

#: Words of a shingle and least similarity of near copies.
SHINGLE, PERCENT = 5, 80


def _filled(docs: DataFrame) -> DataFrame:
    docs = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filled(op8_lines.dedup_lines(docs, report=None))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_jaccard.keep_one(docs, k=SHINGLE, percent=PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filled(op1_suffix.without_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("substrings", substrings), ("packing", packing)]

#: SQL can't express the packing, nor the long repeated strings in time; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs)
            if last is not None:
                drop_stored(last)
            last = docs
    return docs
