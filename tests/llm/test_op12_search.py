import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from engramma.llm import op12_search as m

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(PATTERN.findall((text or "").translate(LOWER)))


def brute(items, docs, k=20):
    """Each item against each document; rows of (item_id, rank, doc_id, score)."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            length = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * length)) for t, times in terms(text).items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def frames(spark, items, docs):
    return spark.createDataFrame([(*r, 1, "z") for r in items], "item_id long, text string, doc_id int, score string").repartition(2), spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, item_id int, n string").repartition(3)


WORDS = ["the", "The", "Été", "été", "a1", "x", "漢字", "don", "t", "_", "\x7f", "­", "zz", "Q", "É"]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(12)
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 40))) for i in range(120)] + [(i, "the été x") for i in range(200, 260)] + [(None, "the été x"), (None, None), (3, "x x zz"), (3, "x x zz"), (7, ""), (8, "rare " * 20_000), (-5, "the été x")]
    items = [(i, say(rng.randrange(0, 9))) for i in range(12)] + [(20, None), (21, "nothing-of-this"), (None, "rare x"), (22, "the the the x"), (22, "the the the x"), (23, "q " * 3000 + "x")]
    return items, docs


def test_equals_brute_force(spark, tables):
    items, docs = tables
    for k in (1, 3, 20, 500):
        got = m.search(*frames(spark, items, docs), k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert result(got) == brute(items, docs, k), k


def test_small_blocks_and_chunks(spark, tables, monkeypatch):
    items, docs = tables
    monkeypatch.setattr(m, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(m, "CHUNK", 3)
    assert result(m.search(*frames(spark, items, docs))) == brute(items, docs)


def test_items_of_one_id(spark):
    items, docs = [(1, "a"), (1, "b"), (2, "a b")], [(1, "a a"), (2, "a b"), (3, "b c")]
    assert result(m.search(*frames(spark, items, docs))) == brute(items, docs)


def test_empty_tables(spark, tables):
    items, docs = frames(spark, *tables)
    assert m.search(items.limit(0), docs).collect() == [] and m.search(items, docs.limit(0)).collect() == []
    assert m.search(items, docs.where("text is null")).collect() == []


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 9, 1 << 17, 1 << 40, (1 << 64) - 1):
        keys = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        assert np.array_equal(m.radix_order(keys), np.argsort(keys, kind="stable"))
    assert len(m.radix_order(np.zeros(0, np.uint64))) == 0


def test_lengths_beyond_64_bits():
    corpus = m.Corpus(10**12, 10**15, np.zeros(0, np.int64))
    assert corpus.lengths(np.array([10**7, 10])).tolist() == [75 + 25 * 10**19 // 10**15, 75]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
        rows = con.execute(m.SQL).fetchall()
    got = result(m.op12_ranked_search(spark, sf))
    assert got == sorted(rows, key=str)
    items, docs = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("benchmark", "documents"))
    assert got == brute([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
