"""Filter interaction audit: what each filter removes in every order of the filters, from 32 counts a part.

Words are exploded and counted by (document, word), then by document for totals and distinct words.
Documents without a word drop out there, so the other flags are joined with it from their side (left outer), as are the
documents that come first of their text, and the labels. A document's five flags are one number of five bits; 32
conditional sums by part (and label) say how many documents fail exactly each set of filters. All orders
follow from these: what stays behind a set of filters is the sum over the flags that don't meet it.

Filters, by letter (fails if): A fewer than `min_words` words; B 100 * distinct words < `min_distinct_percent` * words;
C 100 * capitals A-Z > `max_capital_percent` * code points; D a character of `[#$%&*|]`; E a text that a smaller doc_id has anywhere
in the table, removed or not.

Scale: a text is shuffled once, to where its words are counted, so the (document, word) rows are never shuffled. Equal rows
of one doc_id meet as one text before that, and are counted by their number. Equality of texts is that of two 64-bit hashes (128
bits); a text's first doc_id is a map-side minimum, and the join back is by (text, doc_id), which no copied
text makes hot. Before labels are joined, rows of one doc_id are at most 32 a part. Nothing is collected.

Defined cases: null text is empty (it fails A alone, and E if a smaller doc_id is empty too); null source is the part '';
null doc_id has no label, is never a copy and makes none; rows of one doc_id with different texts are documents of their own;
repeated rows count each; several labels of one doc_id hold if any does; very long texts are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: White space between words, and the characters of filter D.
GAP, SYMBOL = r"[\x20\x09-\x0D]+", "[#$%&*|]"
KEY = ["doc", "text_1", "text_2"]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Helper names only; a null doc_id is 0 with another text hash, so that keys are never null."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.col(id_col).isNotNull()
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"), known.alias("known"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(body).alias("text_1"), F.xxhash64(known, body).alias("text_2"), body.alias("body"),
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """Words and distinct words of each text that has one, by `KEY`."""
    texts = rows.groupBy(*KEY).agg(F.first("body").alias("body"))
    words = texts.select(*KEY, F.explode(F.split("body", GAP)).alias("word")).where(F.col("word") != "")
    pairs = words.groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    return pairs.groupBy(*KEY).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, min_words: int = 200, min_distinct_percent: int = 50, max_capital_percent: int = 2, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """`doc`, `known` (doc_id isn't null), `part`, `fails` (bit i: filter i of FILTERS fails) and `n`, the rows of `docs` that are so."""
    rows = _rows(docs, id_col, text_col, part_col)
    capitals = F.octet_length("body") - F.octet_length(F.regexp_replace("body", "[A-Z]+", ""))
    own = rows.select(*KEY, "known", "part", (100 * capitals > max_capital_percent * F.length("body")).alias("c"), F.col("body").rlike(SYMBOL).alias("d"))
    own = own.groupBy(*own.columns).agg(F.count("*").alias("n"))
    first = own.groupBy("text_1", "text_2").agg(F.min("doc").alias("doc")).withColumn("is_first", F.lit(True))
    all_flags = own.join(word_counts(rows), KEY, "left").join(first, KEY, "left")
    n_words, n_distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    flags = [n_words < min_words, 100 * n_distinct < min_distinct_percent * n_words, F.col("c"), F.col("d"), F.col("known") & F.col("is_first").isNull()]
    fails = sum((flag.cast("int") * (1 << i) for i, flag in enumerate(flags)), F.lit(0))
    return all_flags.select("doc", "known", "part", fails.alias("fails"), "n").groupBy("doc", "known", "part", "fails").agg(F.sum("n").alias("n"))


def failure_sets(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """By part, for all documents, good ones and toxic ones: an array of 32 counts, by the set of filters that fail."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    marked = failed.join(marks.withColumn("known", F.lit(True)), ["doc", "known"], "left")
    marked = marked.select("part", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    by_set = marked.groupBy("part", "good", "toxic").agg(*(F.sum(F.when(F.col("fails") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(SETS)))
    listed = by_set.select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(SETS))).alias("s"))

    def total(where: Column) -> list[Column]:
        return [F.sum(F.when(where, F.col("s")[s]).otherwise(0)) for s in range(SETS)]

    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return listed.groupBy("part").agg(*(F.array(*total(where)).alias(name) for name, where in kinds.items()))


def _passing(sets: str) -> Column:
    """By set of filters: how many pass all of them."""
    return F.expr(f"transform(sequence(0, {SETS - 1}), f -> aggregate(sequence(0, {SETS - 1}), 0L, (t, s) -> t + if((s & f) = 0, {sets}[s], 0L)))")


def orders() -> list[tuple[str, int, str, int, int]]:
    """Order, step, the step's letter, its bit, and the bits of the filters before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(letter) for letter in order]
        out += [("".join(order), i + 1, order[i], bits[i], sum(bits[:i])) for i in range(len(order))]
    return out


def audit(sets: DataFrame) -> DataFrame:
    """A row for each part, order and step from the counts of `failure_sets`."""
    steps = ", ".join(f"('{order}', {step}, '{letter}', {bit}, {before})" for order, step, letter, bit, before in orders())
    known = sets.select("part", "every", *(_passing(c).alias(f"{c}_pass") for c in ("every", "good", "toxic")))
    rows = known.select("*", F.expr(f"inline(array({steps})) as (filter_order, step, letter, bit, before)"))
    lost = lambda c: F.expr(f"{c}_pass[before] - {c}_pass[before | bit]")
    rows = rows.withColumn("removed", lost("every"))
    return rows.select(
        "part", "filter_order", "step", F.expr("every_pass[before | bit]").alias("kept"), "removed",
        (F.expr("every_pass[0] - every_pass[bit]") - F.col("removed")).alias("redundant"), F.expr("every[bit]").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.sum("removed").over(W.partitionBy("part", "letter")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(failure_sets(failures(docs), labels))


SQL = """
with d as materialized (select doc_id, coalesce(source, '') part, coalesce(text, '') body, row_number() over () r from documents),
  w as materialized (select r, word, count(*) n from (select r, unnest(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) word from d) group by 1, 2),
  t as (select r, sum(n) n_words, count(*) n_distinct from w group by 1),
  e as (select body, min(doc_id) least from d group by 1),
  f as materialized (select part, doc_id,
      (coalesce(n_words, 0) < 200)::int + 2 * (100 * coalesce(n_distinct, 0) < 50 * coalesce(n_words, 0))::int
      + 4 * (100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body))::int + 8 * regexp_matches(body, '[#$%&*|]')::int
      + 16 * coalesce(doc_id > least, false)::int fails,
      doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) toxic
    from d left join t using (r) join e using (body)),
  c as materialized (select part, fails, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from f group by 1, 2),
  l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
  o as (select a.letter || b.letter || c.letter || d.letter || e.letter filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits
        from l a, l b, l c, l d, l e where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
  s as (select filter_order, step, bits[step] bit, coalesce(list_sum(bits[1:step - 1]), 0)::int before from o, unnest([1, 2, 3, 4, 5]) u(step)),
  p as (select part, filter_order, step, bit,
      coalesce(sum(n) filter (fails & (before | bit) = 0), 0) kept, coalesce(sum(n) filter (fails & before = 0 and fails & bit > 0), 0) removed,
      coalesce(sum(n) filter (fails & before > 0 and fails & bit > 0), 0) redundant, coalesce(sum(n) filter (fails = bit), 0) unique_fails,
      coalesce(sum(g) filter (fails & before = 0 and fails & bit > 0), 0) good_lost, coalesce(sum(x) filter (fails & before = 0 and fails & bit > 0), 0) toxic_lost
    from c, s group by all)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley
from p
"""
