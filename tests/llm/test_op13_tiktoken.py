import hashlib
import random

import numpy as np
import pytest

from engramma.llm import op13_tiktoken as m

ODD = ["", " ", "  x", "don't 'tis ''s '1s -'ve", "a" * 200_000, "漢字" * 60_000, "é́a1_2b 3", "   z", "a\x1cb\x1fc", "!!!???" * 20_000, "x  \n\n y\t ", "\U0001f600" * 999, "é" * 70_000, "ab'" * 50_000]
WHITE = [" " * 5000, " " * 5000 + "x", "x" + "\n" * 9000 + " y", " " * 70_000 + "'s", "\x1c" * 9000 + "q", "a " * 9000 + " \t" * 4000 + "\x1fb" + " " * 4096]


@pytest.fixture(scope="module")
def model():
    return m.tokenizer(*m.defaults())


def want(model, text):
    ids = model.encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_equals_library(model):
    rng = random.Random(5)
    texts = ODD + WHITE + ["".join(rng.choice("aeé'sxt1 2\n\t_-!漢́  ") for _ in range(rng.randrange(1, 600))) for _ in range(300)]
    for t in texts:
        assert model.digest(t) == want(model, t), t[:50]
        assert model.decode(model.encode(t)) == t.encode()


def test_any_slice_size_gives_the_same_ids(model):
    rng = random.Random(6)
    for _ in range(150):
        t = "".join(rng.choice(["a", "é", "'", "s", "'ll", "1", "٣", " ", "  ", "\n", "　", "_", "!", "漢", "́"]) for _ in range(rng.randrange(1, 120)))
        ids = model.encoding.encode_ordinary(t)
        for size in (1, 2, 5, 17):
            pieces = list(model.pieces(t, size))
            assert np.concatenate(pieces).tolist() == ids, (t, size)
            assert "".join(p for _, p in m.slices(t, size)) == t


def test_slices_are_short(model):
    assert max(len(p) for _, p in m.slices("lorem ipsum, " * 40_000)) < m.SLICE + 20
    assert [w for w, _ in m.slices("a" + " " * 9000 + "b")] == [False, True, False]


def test_white_space_that_the_library_cannot_match(model):
    run = " " * 1_200_000
    n, _, decoded = model.digest(run + "x")
    shorter = model.encoding.encode_ordinary(" " * 12_000 + "x")  # every blank of a run is a token
    assert n == len(shorter) + len(run) - 12_000
    assert decoded == hashlib.sha256((run + "x").encode()).hexdigest()


def test_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "Hi you"), (3, "Hi"), (3, "Hi"), (4, "w " * 90_000)]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted((tuple(r) for r in m.round_trip(docs).collect()), key=str)
    assert got == sorted(((d, *want(model, t or "")) for d, t in rows), key=str)
    assert m.round_trip(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark, model):
    docs = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    assert tuple(m.round_trip(docs).head())[1:] == want(model, "a�b")


def test_encode_then_decode(spark):
    rows = [(1, "héllo  wörld"), (2, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = m.encode(docs)
    got = {r.doc_id: bytes(r.decoded).decode() for r in m.decode(tokens).collect()}
    assert got == {d: t or "" for d, t in rows}
    assert bytes(m.decode(spark.sql("select 5L doc_id, cast(null as array<int>) ids")).head().decoded) == b""
    with pytest.raises(Exception, match="no token has the id"):
        m.decode(spark.sql("select 5L doc_id, array(99999999) ids")).collect()


def test_full_table(spark, model):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, m.op13_tiktoken_digest(spark, sf).collect())) == sorted((r.doc_id, *want(model, r.text or "")) for r in docs)
