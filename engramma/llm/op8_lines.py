"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its text without white space at its ends, and its words are what single
blanks separate.  A line is removed if an earlier one (smaller doc_id, then line
number) is equal, or, from `near_words` words on, is within one insertion, deletion or
substitution of a word; earlier lines are taken from the input, removed or not.
Lines of fewer than `min_bytes` bytes (by default: blank ones) are left alone.

Deletion neighbourhood: a line and its variants with one word left out are hashed;
two lines are within the bound exactly if they share such a key (both with the same
word left out, or one with none).  Beyond `DIRECT` words a variant's hash is the sum of its words' hashes, each keyed by
the word's place, so all variants of a line follow from two running sums and take time in proportion to its words.
Since an earlier neighbour is all that matters, each
key gives its least line by a map-side `min`, so that the work is linear in the
variants however many lines share one; the pair found is then verified word by
word.  Where the least one fails that (two variants of one hash), all earlier lines of all keys of the
line are verified, so a collision hides nothing.  Variants are only made for lines that can have a neighbour: of two lines within one
edit, the first or the last half of the longer one's words agree, and then also half
of the remainder; lines that share such a key with no other line are left out, which
loses nothing.

Equal lines are one class (two 64-bit hashes) from the start.

Defined cases: null text has one empty line; null doc_id orders after all others;
rows with equal doc_id and text are one document (each row gets its result), rows
with equal doc_id and other texts are ordered by text hash; other columns are kept
by `dedup_lines` and never clash, since all helper columns live in structs and the report takes a free name;
a line of any length is compared whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import scratch, store

MIN_BYTES, NEAR_WORDS = 1, 5
BITS61 = (1 << 61) - 1
CHUNK = 256
DIRECT = 128  # pairs whose longer line has at most so many words: their variants are hashed as they are, which is quicker for short lines
LAST = (1 << 63) - 1
WHITE = " \t\r\x0b\x0c"


def bare(line: Column) -> Column:
    """Without white space at its ends; most lines have none there, and trimming looks at all of a line."""
    edges = [f(line, F.lit(c)) for c in WHITE for f in (F.startswith, F.endswith)]
    return F.when(functools.reduce(lambda x, y: x | y, edges), F.btrim(line, F.lit(WHITE))).otherwise(line)


def n_words(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1


def first_words(s: Column, n: Column) -> Column:
    return F.call_function("substring_index", s, F.lit(" "), n)


def last_words(s: Column, n: Column) -> Column:
    return F.call_function("substring_index", s, F.lit(" "), -n)


# Keys are columns of longs and no structs, which sort many times slower.
AT = ["o", "t", "n"]  # order of all lines of the corpus: document, text of equal documents, line


def document_key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t")]


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """(o, t, n, s): place and text of each line."""
    text = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    out = docs.select(*document_key(id_col, text_col), F.posexplode(text).alias("n", "line"))
    return out.select(*AT, bare(F.col("line")).alias("s")).where(F.octet_length("s") >= min_bytes)


def _keys(s: Column, n: Column, pieces) -> Column:
    """Hashed keys of the line of n words as the longer (m = n) or the shorter (m = n + 1) of a pair."""
    out = []
    for m in (n, n + 1):
        half = F.floor((m - 1) / 2).cast("int")
        part = F.floor((m - half - 1) / 2).cast("int")
        out += [F.xxhash64(F.lit(i), m, *cols) for i, cols in enumerate(pieces(lambda k: first_words(s, k), lambda k: last_words(s, k), half, part))]
    return F.array(*out)


def _halves(first, last, half, part):
    return [[first(half)], [last(half)]]


def _three_quarters(first, last, half, part):
    return [[first(half + part)], [first(half), last(part)], [last(half + part)], [last(half), first(part)]]


def _shared(rows: DataFrame, keys: Column, ident: list[str]) -> DataFrame:
    """Identities (columns) that have a key in common with another one."""
    each = rows.select(*ident, F.explode(F.array_distinct(keys)).alias("key"))
    common = store(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    return each.join(common, "key", "left_semi").select(*ident).distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """Word edit distance at most one, from the first difference on."""
    n, m = F.size(a), F.size(b)
    same = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")  # 1-based, 0: none
    tail = lambda x, skip: F.slice(x, same + skip, F.greatest(F.size(x) - same - skip + 1, F.lit(0)))
    return (F.abs(n - m) <= 1) & (
        (same == 0) | F.when(n == m, tail(a, 1) == tail(b, 1)).when(n > m, tail(a, 1) == tail(b, 0)).otherwise(tail(a, 0) == tail(b, 1))
    )


def add(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(F.lit(BITS61))


def running(values: Column) -> Column:
    """Sums modulo 2**61 of what is before each element, and of all. A step copies the sums so far: for short arrays."""
    zero = F.lit(0).cast("long")
    step = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    return F.aggregate(values, F.array(zero), step)


def running_by_chunk(s: Column, shift: int) -> Column:
    """For each chunk of words the sums of the hashes before each word and before the next chunk, over the whole line; a word's hash is keyed by its place, less `shift`."""
    words = rf"(?!\z)((?:[^ ]* ){{0,{CHUNK - 1}}}+[^ ]*+)(?: |\z)"
    place = lambda w, k, i: F.xxhash64(w, k * CHUNK + i - shift).bitwiseAND(F.lit(BITS61))
    inside = F.transform(F.regexp_extract_all(s, F.lit(words), 1), lambda c, k: running(F.transform(F.split(c, " "), lambda w, i: place(w, k, i))))
    before = running(F.transform(inside, lambda r: F.element_at(r, -1)))
    return F.zip_with(inside, F.slice(before, 1, F.size(inside)), lambda r, b: F.transform(r, lambda x: add(x, b)))


def variant_hashes(s: Column) -> Column:
    """Hash of the line, then of each of its variants with one word left out, in order."""
    head, behind = running_by_chunk(s, 0), running_by_chunk(s, 1)  # words behind the gap move up by one place
    before = F.flatten(F.transform(head, lambda r: F.slice(r, 1, F.size(r) - 1)))
    through = F.flatten(F.transform(behind, lambda r: F.slice(r, 2, F.size(r) - 1)))
    last = lambda x: F.element_at(F.element_at(x, -1), -1)
    gap = F.zip_with(before, through, lambda x, y: x - y)
    return F.concat(F.array(last(head)), F.zip_with(gap, F.array_repeat(last(behind), n_words(s)), add))


def without_word(s: Column, size: Column, dropped: Column) -> Column:
    """The line less a word, or whole (0)."""
    head, tail = first_words(s, dropped - 1), last_words(s, size - dropped)
    return F.when(dropped == 0, s).when(dropped == 1, tail).when(dropped == size, head).otherwise(F.concat(head, F.lit(" "), tail))


def near_pairs(variants: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, w): lines with an earlier one that shares a key; the least one by key, or, for the lines of `wanted`, each."""
    keys = ["v", "longer"]
    if wanted is not None:
        mine = variants.join(wanted, "id", "left_semi")
        others = variants.select(*keys, F.col("dropped").alias("d"), F.col("id").alias("w")).join(mine.select(*keys).distinct(), keys, "left_semi")
        same = ((F.col("d") == F.col("dropped")) & (F.col("d") > 0)) | ((F.col("d") == 0) != (F.col("dropped") == 0))
        return mine.join(others, keys).where((F.col("w") < F.col("id")) & same).select("id", "w").distinct()
    by_word = variants.where("dropped > 0").groupBy(*keys, "dropped").agg(F.min("id").alias("w"), F.count("*").alias("c")).where("c > 1")
    by_key = variants.groupBy(*keys).agg(F.min(F.when(F.col("dropped") == 0, F.col("id"))).alias("whole"), F.min(F.when(F.col("dropped") > 0, F.col("id"))).alias("cut"))
    by_word, by_key = store(by_word), store(by_key.where("whole is not null and cut is not null"))
    pairs = variants.join(by_word, [*keys, "dropped"]).select("id", "w")
    pairs = pairs.union(variants.join(by_key, keys).select("id", F.when(F.col("dropped") == 0, F.col("cut")).otherwise(F.col("whole"))))
    return pairs.where("w < id").groupBy("id").agg(F.min("w").alias("w"))


def near_lines(known: DataFrame, near_words: int) -> DataFrame:
    """Places (o, t, n) of lines (id, place, s, size), numbered in order, that have an earlier one within one edit."""
    # dropped: number of the word left out, 0 for none; longer: words of the longer line of a pair with this key
    size, longer = F.col("size"), F.when(F.col("dropped") == 0, F.col("size") + 1).otherwise(F.col("size")).alias("longer")
    cuts = known.where(size <= DIRECT).select("id", "s", "size", F.explode(F.sequence(F.lit(0), size)).alias("dropped"))
    short = cuts.select("id", "dropped", longer, F.xxhash64(without_word(F.col("s"), size, F.col("dropped"))).alias("v")).where(F.col("longer") <= DIRECT)
    long = known.where(size >= DIRECT).select("id", "size", F.posexplode(variant_hashes(F.col("s"))).alias("dropped", "v"))
    long = long.select("id", "dropped", longer, "v").where(F.col("longer") > DIRECT)
    variants = store(short.union(long).where(F.col("longer") >= near_words))
    left = known.select(F.col("id").alias("w"), F.col("s").alias("s1"))
    near = within_one_edit(F.split("s", " "), F.split("s1", " "))
    verified = lambda pairs: pairs.join(known, "id").join(left, "w").select("id", *AT, near.alias("near"))
    checked = store(verified(near_pairs(variants)))
    at = checked.where("near").select(*AT)
    if checked.where("not near").isEmpty():
        return at
    more = verified(near_pairs(variants, checked.where("not near").select("id"))).where("near")
    return at.union(store(more.select(*AT).distinct()))


def once(values: dict[str, Column], f) -> Column:
    """f of a struct of values that are computed once for the row, and not once for each element that f looks at."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(name) for name, v in values.items()])), f), 1)


def between(items: Column, gone: Column) -> Column:
    """Elements of an array but those at the sorted places `gone` (from 0): the slices between them, in time in proportion to both."""
    cuts = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(items))).alias("b"))
    return F.flatten(F.transform(cuts, lambda c: F.slice(items, c["a"] + 2, c["b"] - c["a"] - 1)))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, near_words: int = NEAR_WORDS) -> DataFrame:
    """(o, t, gone): of each document that loses lines, their numbers from 0 on."""
    hashes = [F.xxhash64("s").alias("ha"), F.xxhash64(F.lit(1), "s").alias("hb")]
    lines = lines_of(docs, id_col, text_col, min_bytes).select(*AT, *hashes, "s", n_words(F.col("s")).alias("words"))
    halves = F.when(F.col("words") >= near_words - 1, _keys(F.col("s"), F.col("words"), _halves))
    classes = lines.select(*AT, "ha", "hb", halves.alias("halves")).groupBy("ha", "hb").agg(F.min(F.struct(*AT)).alias("at"), F.count("*").alias("c"), F.first("halves").alias("halves"))
    classes = store(classes.select("ha", "hb", "at.*", "c", "halves"))

    near = _shared(classes.where("halves is not null"), F.col("halves"), AT)
    wanted = near.groupBy("o", "t").agg(F.collect_set("n").alias("ns"))
    texts = docs.select(*document_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    texts = texts.join(wanted, ["o", "t"]).dropDuplicates(["o", "t"])
    pick = once({"ls": F.split("body", "\n"), "ns": F.col("ns")}, lambda r: F.transform(r["ns"], lambda n: F.struct(n.alias("n"), F.element_at(r["ls"], n + 1).alias("line"))))
    known = texts.select("o", "t", F.inline(pick)).select(*AT, bare(F.col("line")).alias("s"))
    known = store(known.withColumn("size", n_words(F.col("s"))))
    close = _shared(known, _keys(F.col("s"), F.col("size"), _three_quarters), AT)
    # numbers in the order of places: ranges follow one another, and so do numbers within one; written once, so they stand
    ordered = store(known.join(close, AT, "left_semi")).repartitionByRange(*AT).sortWithinPartitions(*AT)
    known = store(ordered.withColumn("id", F.monotonically_increasing_id()))

    # all later occurrences of a class, and first occurrences with an earlier neighbour
    many = store(classes.where("c > 1").select("ha", "hb", *[F.col(c).alias(f"f{c}") for c in AT]))
    again = lines.select(*AT, "ha", "hb").join(many, ["ha", "hb"]).where("o <> fo or t <> ft or n <> fn").select(*AT)
    gone = again.union(near_lines(known, near_words)).groupBy("o", "t").agg(F.sort_array(F.collect_set("n")).alias("gone"))
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: str | None = "lines", **limits) -> DataFrame:
    """`docs` with `text` less the removed lines, and a struct (total, removed) named `report`, with underscores before it if `docs` has such a column."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(store(removed_lines(docs, id_col, text_col, **limits).select(F.struct("o", "t", "gone").alias("_g"))))
    rows = docs.select(F.struct("*").alias("_d"), F.struct(*document_key(id_col, text_col)).alias("_k"))
    rows = rows.join(gone, (F.col("_k.o") == F.col("_g.o")) & (F.col("_k.t") == F.col("_g.t")), "left")
    ls = F.split(F.coalesce(F.col("_d")[text_col].cast("string"), F.lit("")), "\n")
    kept = once({"ls": ls, "gone": F.col("_g.gone")}, lambda r: between(r["ls"], r["gone"]))
    body = F.when(F.col("_g.gone").isNull(), F.col("_d")[text_col]).otherwise(F.array_join(kept, "\n"))
    fields = [body.alias(c) if c == text_col else F.col("_d")[c].alias(c) for c in docs.columns]
    if report is None:
        return rows.select(*fields)
    while report in docs.columns:
        report = f"_{report}"
    total = F.struct(F.size(ls).cast("long").alias("total"), F.coalesce(F.size("_g.gone"), F.lit(0)).cast("long").alias("removed"))
    return rows.select(*fields, total.alias(report))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = dedup_lines(docs)
    return got.select("doc_id", F.col("lines.total").alias("n_lines"), F.col("lines.removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::int n, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
  w as materialized (select doc_id, n, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) s from l),
  e as materialized (select *, string_split(s, ' ') ws, min(doc_id * 1000000 + n) over (partition by s) f from w where s <> ''),
  c as materialized (select distinct s, ws, f from e where len(ws) >= 4),
  v as materialized (select f, i, case when i = 0 then len(ws) + 1 else len(ws) end longer,
          case when i = 0 then s else array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') end var from c, unnest(range(0, len(ws) + 1)) t(i)),
  a as (select a.f from v a join (select var, longer, i, min(f) f from v where i > 0 and longer >= 5 group by 1, 2, 3) b
          on a.var = b.var and a.longer = b.longer and a.i = b.i and b.f < a.f
        union all
        select a.f from v a join (select var, longer, i = 0 whole, min(f) f from v where longer >= 5 group by 1, 2, 3) b
          on a.var = b.var and a.longer = b.longer and (a.i = 0) <> b.whole and b.f < a.f),
  g as (select distinct doc_id, n from e where doc_id * 1000000 + n <> f or f in (select f from a)),
  r as (select w.doc_id, count(*) n_lines, count(g.n) n_removed, coalesce(string_agg(line, chr(10) order by w.n) filter (g.n is null), '') kept
        from w left join g on w.doc_id = g.doc_id and w.n = g.n group by 1)
select doc_id, n_lines::bigint n_lines, n_removed::bigint n_removed, sha256(kept) kept_sha256 from r
"""
