"""Ranked lexical search by sort-based accumulation.

A set of queries (items) is asked of all documents. One pass over the texts finds, by document, its
number of terms and how often it holds each term that an item asks for; these postings are
stored, and give the corpus statistics: documents, terms, documents by term. A second pass, over the postings, turns
them into impacts, concatenates the (item, document, impact) arrays of a chunk of documents, sorts their packed keys by radix (16 bits a
pass), and sums equal keys with `reduceat`. Each task keeps an item's best `k` in a heap; as a document is in
one task only, these hold the item's best `k` of all. The heaps of all tasks are dealt out by ranges of (item, score), cut
to `k` an item in each range, and ranked by item: what meets in one task is `k` rows a range, not a row a task.

Terms are maximal runs of letters and digits (ASCII) and bytes beyond ASCII; only A-Z are lower-cased. They are compared by 64-bit hashes
of mixes keyed by place. Scores are integers (64 bits): see `Corpus.weights` and `impacts`.

Scale: items go in blocks of at most `BLOCK_ITEMS` and `BLOCK_TEXT` bytes of text (or one item), each asked of all documents; a block's terms, with their counts,
are all that passes through the driver and is sent to tasks, whatever the documents' number. Postings hold terms of items only.

Defined cases: null and empty texts have no term (they count nowhere, and such an item finds nothing); equal scores rank by ascending doc_id, null
last; rows of one doc_id are documents of their own, and so may rank twice; equal rows of items are one item, rows of one item_id with different
texts are ranked each on its own; very long texts are read whole; without documents or items there are no rows; other columns are ignored and never clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.llm.common import U64, Block, blocks, bounded_batches, id_and_bytes, scratch, span_hashes, store

K = 20
BLOCK_ITEMS, BLOCK_TEXT = 1 << 14, 8 << 20
CHUNK = 1 << 20  # impacts sorted at once
LAST = (1 << 63) - 1
POSTINGS = "doc_id long, n long, term array<int>, tf array<int>"
BEST = "item int, item_id long, score long, doc_id long"

#: The bytes between terms.
_GAPS = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAPS[_low : _high + 1] = True


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys, by digits of 16 bits from the lowest on; digits that all keys share are passed over."""
    order = np.arange(len(keys))
    differ = int(np.bitwise_or.reduce(keys ^ keys[0])) if len(keys) else 0
    for shift in range(0, differ.bit_length(), 16):
        if (differ >> shift) & 0xFFFF:
            order = order[np.argsort((keys[order] >> U64(shift)).astype(np.uint16), kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which sorted keys change (the first one too), and the keys there."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return first, keys[first]


class Terms:
    """Terms of a block of texts: place of its document, and hash."""

    def __init__(self, block: Block):
        starts, ends, self.doc = block.words(lower=True, gaps=_GAPS)
        self.hashes = span_hashes(block.data, starts, ends)


@dataclass
class Items:
    """A block of items: its terms (sorted hashes), and by term the items that hold it and how often."""

    ids: list
    hashes: np.ndarray
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        texts = [(text or "").encode("utf-8") for _, text in rows]
        data = np.frombuffer(b"".join(texts), np.uint8)
        terms = Terms(Block(data, np.cumsum([0, *map(len, texts)]), 0))
        hashes, term = np.unique(terms.hashes, return_inverse=True)
        pairs, times = np.unique((term.astype(U64) << U64(32)) | terms.doc.astype(U64), return_counts=True)
        start = np.searchsorted(pairs >> U64(32), np.arange(len(hashes) + 1, dtype=U64))
        return cls([i for i, _ in rows], hashes, start, (pairs & U64(0xFFFFFFFF)).astype(np.int64), times.astype(np.int64))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """(id, text) of distinct items in blocks of bounded size, read from one partition at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(r.t or "") > BLOCK_TEXT):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t or "")
    if block:
        yield block


def postings(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a term: their number of terms, and which of the items' terms they hold how often."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in blocks(batch.column(1)):
                terms = Terms(block)
                n = np.bincount(terms.doc, minlength=block.n)
                at = np.searchsorted(items.hashes, terms.hashes)
                at[at == len(items.hashes)] = 0
                asked = items.hashes[at] == terms.hashes if len(items.hashes) else np.zeros(len(at), bool)
                keys = (terms.doc[asked].astype(U64) << U64(32)) | at[asked].astype(U64)
                keys = keys[radix_order(keys)]
                first, key = grouped(keys)
                tf = np.diff(np.append(first, len(keys)))
                some = np.flatnonzero(n)
                ends = np.searchsorted(key >> U64(32), np.append(some, block.n).astype(U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n).take(pa.array(some)),
                        pa.array(n[some].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((key & U64(0xFFFFFFFF)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "term", "tf"],
                )

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, POSTINGS)


@dataclass
class Corpus:
    """Documents with a term, their terms with repeats, and by term the documents that hold it."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    @classmethod
    def of(cls, found: DataFrame, n_terms_asked: int) -> Corpus:
        total = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
        df = np.zeros(n_terms_asked, np.int64)
        for r in found.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        return cls(total.docs, total.terms, df)

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.df], np.int64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """A document's length against the mean one, in percent, a quarter of it counted."""
        if 25 * int(n.max(initial=0)) * self.n_docs <= LAST:
            return 75 + (25 * self.n_docs * n) // max(1, self.n_terms)
        return np.array([75 + 25 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * length))


def accumulate(items: Items, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, document and summed impact of all that match, in that order."""
    many = items.start[term + 1] - items.start[term]
    run = np.cumsum(many) - many
    at = np.arange(int(many.sum())) - np.repeat(run - items.start[term], many)
    keys = (items.item[at].astype(U64) << U64(32)) | np.repeat(doc, many).astype(U64)
    values = np.repeat(impact, many) * items.times[at]
    order = radix_order(keys)
    first, key = grouped(keys[order])
    total = np.add.reduceat(values[order], first) if len(first) else values[:0]
    return (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64), total


class Best:
    """By item, the `k` best of (score, doc_id) in a heap whose top is the worst of them; scores of 0 are none."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.score, self.doc = np.zeros(n_items, np.int64), np.full(n_items, -LAST - 1, np.int64)  # what an entry must beat

    def push(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        able = (score > self.score[item]) | ((score == self.score[item]) & (doc < self.doc[item]))
        for i, s, d, x in zip(item[able].tolist(), score[able].tolist(), doc[able].tolist(), null[able].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d, x))
            elif (s, -d, x) > heap[0]:
                heapq.heapreplace(heap, (s, -d, x))
            if len(heap) == self.k:
                self.score[i], self.doc[i] = heap[0][0], -heap[0][1]


def best_of_tasks(found: DataFrame, items: Items, corpus: Corpus, k: int) -> DataFrame:
    weight = corpus.weights()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = Best(len(items.ids), k)
        for batch in batches:
            term, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            ids = batch.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(LAST).to_numpy()
            held = batch.column(2).value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(held)), held)
            impact = impacts(weight[term], tf, corpus.lengths(batch.column(1).to_numpy())[doc])
            border = np.append(0, np.cumsum(held))
            before = np.append(0, np.cumsum(items.start[term + 1] - items.start[term]))[border]
            i = 0
            while i < len(held):  # documents whose impacts come to a chunk, or one of more
                j = max(i + 1, int(np.searchsorted(before, before[i] + CHUNK, "right")) - 1)
                part = slice(border[i], border[j])
                item, d, score = accumulate(items, doc[part], term[part], impact[part])
                best.push(item, score, ids[d], null[d])
                i = j
        out = [(i, items.ids[i], s, None if x else -d) for i, heap in enumerate(best.heaps) for s, d, x in heap]
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["item", "item_id", "score", "doc_id"])

    return bounded_batches(found).mapInArrow(run, BEST)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """Ranks of a stored table of tasks' best rows: cut in each range of (item, score) first, then by item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = best.repartitionByRange("item", *order).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
    return rows.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's `k` best documents."""
    spark, out = docs.sparkSession, []
    with scratch(spark) as keep:
        for rows in item_blocks(items, item_id, item_text):
            block = Items.of(rows)
            found = store(postings(docs, block, id_col, text_col))
            best = store(best_of_tasks(found, block, Corpus.of(found, len(block.hashes)), k))
            out.append(keep(store(ranked(best, k))))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = f"unnest(regexp_extract_all(translate(text, '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term"
SQL = f"""
with q as materialized (select item, any_value(item_id) item_id, term, count(*) times
       from (select item, item_id, {_SPLIT} from (select item_id, text, row_number() over () item from (select distinct item_id, text from benchmark))) group by item, term),
  t as materialized (select r, any_value(doc_id) doc_id, term, count(*) tf from (select r, doc_id, {_SPLIT} from (select doc_id, text, row_number() over () r from documents)) group by r, term),
  d as (select r, sum(tf)::bigint n from t group by 1),
  c as (select count(*) nn, sum(n)::bigint ll from d),
  w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint w from (select term, count(*) df from t group by 1), c),
  m as (select r, 75 + (25 * n * nn) // ll m from d, c),
  s as (select item, any_value(item_id) item_id, r, any_value(doc_id) doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
        from t join q using (term) join w using (term) join m using (r) group by item, r)
select item_id, rank::int rank, doc_id, score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls last) rank from s where score > 0) where rank <= 20
"""
