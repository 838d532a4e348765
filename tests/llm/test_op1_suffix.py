import hashlib
import random

import numpy as np
import pytest

from engramma.llm import op1_suffix as m

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    """rows: (doc_id, bytes), by doc_id. First occurrence of each window; later ones cover bytes."""
    seen, out = {}, []
    for d, raw in rows:
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i] += 1
                gone[i + length] -= 1
            else:
                seen[w] = True
        mark = np.cumsum(gone)[: len(raw)] > 0
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, mark, strict=True) if not g)
        out.append((d, len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    n = lambda spans: sum(s["end"] - s["start"] for s in spans)
    return sorted((r.doc_id, r.n_bytes, n(r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def sample(seed, n=60):
    rng = random.Random(seed)
    syllables = ["an", "the", "ré", " ", " ", "on", "\n", "st", "ê"]
    text = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    shared = [text(rng.randrange(5, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(1000, rows[3][1]), (1001, "ab" * 300), (1002, "x" * 500), (1003, "x" * 700), (1004, "abc" * 90 + "ab" * 90)]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 16), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, kept binary, o int").repartition(5)
    got = result(m.dedup_substrings(df, length=30, gram=10, hot=hot))
    assert got == brute([(d, t.encode()) for d, t in sorted(rows)], 30)


def test_small_batches_and_collections(spark):
    old = m.BATCH, m.COLLECTION, m.PIECE, m.GROUP
    rows = sample(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    try:  # the workers are forked with these values
        m.BATCH, m.COLLECTION, m.PIECE, m.GROUP = 500, 400, 64, 2000
        got = result(m.dedup_substrings(df, length=30, gram=10))
    finally:
        m.BATCH, m.COLLECTION, m.PIECE, m.GROUP = old
    assert got == brute([(d, t.encode()) for d, t in sorted(rows)], 30)


def test_merge_equals_sorting():
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 250):
        size = rng.integers(30, 90, 40)
        data = rng.integers(0, alphabet, size.sum()).astype(np.uint8)
        start = np.cumsum(size) - size
        for i in range(0, 38, 3):  # equal stretches
            data[start[i + 1] : start[i + 1] + 28] = data[start[i] : start[i] + 28]
        table = m.symbols(data, start, size)
        plan = m.steps(table, 25)
        assert sum(plan) == 25
        code, prev = dict(table), {q: m.before(start, size, q) for q in set(plan)}
        cut = start[[10, 17, 33]].tolist()
        shards = [m.transform(np.arange(a, b), plan, code, prev) for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
        rotation, block = m.merge(shards, plan, code, prev)
        ring = lambda p: bytes(np.tile(data[start[s] : start[s] + size[s]], 3)[p - start[s] :][:25]) if (s := int(np.searchsorted(start, p, "right") - 1)) >= 0 else b""
        keys = [ring(p) for p in rotation]
        assert sorted(rotation.tolist()) == list(range(len(data)))
        for i in range(1, len(keys)):
            assert (keys[i] == keys[i - 1]) == (block[i] == block[i - 1])
        assert len(set(keys)) == block[-1] + 1


def test_full_table_against_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, m.op1_suffix_dedup(spark, SF).collect())) == brute(sorted(rows), 100)


def test_odd_rows(spark):
    long = "the quick brown fox " * 3 + "jumps over a lazy dog and then some more words follow here"
    rows = [(None, long), (5, long), (5, long), (6, None), (7, ""), (8, "short"), (9, long + "!"), (9, long + "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans)) for r in m.dedup_substrings(df).collect())
    n = len(long)
    assert got == [(0, n, n), (5, n, 0), (5, n, 0), (6, 0, 0), (7, 0, 0), (8, 5, 0), (9, n + 1, n), (9, n + 1, n)]
    assert m.dedup_substrings(df.limit(0)).count() == 0


def test_common_prefixes_of_the_merged_order():
    """Against sorting all rotations and comparing neighbours."""
    rng = random.Random(21)
    for _ in range(12):
        texts = ["".join(rng.choice("ab\u00e9 ") for _ in range(rng.randrange(1, 90))).encode() for _ in range(rng.randrange(1, 9))]
        texts += rng.sample(texts, min(2, len(texts))) + [b"ab" * 30]
        size = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, length = np.cumsum(size) - size, rng.choice([7, 20, 30])
        table = m.symbols(data, start, size)
        plan, code = m.steps(table, length), dict(table)
        prev = {q: m.before(start, size, q) for q in set(plan)}
        ends = np.append(start, len(data))
        cut = sorted({0, len(size) // 3, 2 * len(size) // 3, len(size)})
        shards = [m.transform(np.arange(ends[a], ends[b], dtype=np.int32), plan, code, prev) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        rotation, _, common = m.interleave(shards, plan, code, prev)
        own = np.repeat(np.arange(len(size)), size)
        head = [(texts[k] * (length // len(texts[k]) + 2))[i - start[k] :][:length] for i, k in enumerate(own)]
        assert [head[i] for i in rotation] == sorted(head)
        shared = [next((j for j in range(length) if x[j] != y[j]), length) for x, y in zip([head[i] for i in rotation], [head[i] for i in rotation[1:]], strict=False)]
        assert m.common_prefixes(data, size, rotation, common, length)[1:].tolist() == shared
