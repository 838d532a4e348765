import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from engramma.llm import op2_bpe
from engramma.llm import op5_tokencount as m


def plain(tokens, end):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


def test_flat_files(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for k, n in enumerate((0, 1, 7, 500, 2600)):
        tokens = [65535 if rng.random() < (0.02 if k == 4 else 0.3) else rng.randrange(100) for _ in range(n)]
        (tmp_path / f"part{k}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
        want[f"part{k}.bin"] = plain(tokens, 65535)
    for block in (1, 3, 64):
        old, m.SUPER = m.SUPER, 4
        try:
            got = m.count_tokens(m.file_blocks(spark, str(tmp_path), block_tokens=block)).collect()
        finally:
            m.SUPER = old
        mine = {f: sorted((r.doc_no, r.start_token, r.n_tokens, r.closed) for r in got if r.file.endswith(f)) for f in want}
        assert mine == want


def test_file_beyond_two_gb(spark, tmp_path):
    """A sparse file: zeros, and separators near its start, behind 2^31 bytes, and at its end."""
    path, places = tmp_path / "huge.bin", [5, (1 << 30) + 7, (1 << 30) + 50_000_000]
    with open(path, "wb") as f:
        for at in places:
            f.seek(2 * at)
            f.write(b"\xff\xff")
    got = m.count_tokens(m.file_blocks(spark, str(tmp_path), block_tokens=1 << 23)).collect()
    assert sorted((r.doc_no, r.start_token, r.n_tokens) for r in got) == [(0, 0, 5), (1, 6, places[1] - 6), (2, places[1] + 1, places[2] - places[1] - 1)]


def test_broken_file_is_refused(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        m.file_blocks(spark, str(tmp_path)).collect()


def test_documents(spark):
    theirs = Tokenizer.from_file(op2_bpe.default_path())
    rows = [(5, "a b c"), (5, "a b c"), (6, None), (7, ""), (3000, " x "), (None, "lone text"), (None, None), (8, "w " * 7000), (9, "unusualword" * 900), (10, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, file int, docs int").repartition(3)
    n = {i: len(theirs.encode(t or "", add_special_tokens=False).ids) for i, (_, t) in enumerate(rows)}
    for size in (1, 64, 1000):
        blocks = m.store(m.flat_blocks(df, op2_bpe.default_path(), block_tokens=size))
        got = m.count_tokens(blocks).collect()
        key = lambda d, k: (-1 if d is None else d, k)
        assert sorted(key(r.doc_id, r.n_tokens) for r in got) == sorted(key(d, n[i]) for i, (d, _) in enumerate(rows))
        assert all(r.closed for r in got)
        for f in {r.file for r in got}:  # documents of a file follow one another
            own = sorted((r.doc_no, r.start_token, r.n_tokens) for r in got if r.file == f)
            assert [x[0] for x in own] == list(range(len(own))) and own[0][1] == 0
            assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(own, own[1:], strict=False))
    assert m.count_tokens(m.flat_blocks(df.limit(0), op2_bpe.default_path())).count() == 0


def test_full_table_against_library(spark):
    sf = "/root/testdata/sf0.001"
    theirs = Tokenizer.from_file(op2_bpe.default_path())
    want = sorted((r.doc_id, len(theirs.encode(r.text or "", add_special_tokens=False).ids)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in m.op5_separator_scan(spark, sf).collect()) == want
