import random
import re

import numpy as np

from engramma.llm import op6_quality as m
from engramma.llm.common import Block, span_hashes
from tests.llm.test_pipeline import good

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    many = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(8)}
    seen, dup = set(), 0
    for s in text.split("\n"):
        if re.search(WORD, s):
            dup += s in seen
            seen.add(s)
    failed = len(words) < 20 or 100 * len(many) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(many), failed, good(text)


def sample():
    rng = random.Random(4)
    out = [None, "", " \n\t\x0b\x0c\r ", "one", "a b  c", "é" * 30 + " x", "line\nline\nline \n\nline", "w " * 50000, "# * $ % & | < >" * 4, "no break at end\r\nno break at end\r\n"]
    vocab = ["the", "of", "ré", "日本", "x#", "and", "thing", "a"]
    for _ in range(120):
        words = [rng.choice(vocab) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.5 and len(words) > 30:
            words += words[: rng.randrange(5, 30)]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    return out


def test_against_brute_force(spark):
    texts = sample()
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)] + [(5, texts[5], 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in m.quality_rules(df).collect())
    assert got == sorted(key((i, *brute(t))) for i, t, _ in rows)
    kept = m.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.n_words for r in kept.collect()) == sorted(i for _, t, i in rows if brute(t)[-1])
    assert m.quality_rules(df.limit(0)).count() == 0 and m.keep_good(df.limit(0)).count() == 0


def test_patterned_lines_are_told_apart():
    """Bytes in the Thue-Morse pattern and its complement are equal under polynomials modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    data = np.frombuffer(f"{a}\n{b}".encode(), np.uint8)
    hashes = span_hashes(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert hashes[0] != hashes[1]
    got = m.measure(Block(data, np.array([0, len(data)]), 0), m.Rules())
    assert got["n_dup_lines"][0] == 0
    x = span_hashes(np.concatenate([data[:30], data[:30]]), np.array([0, 0, 8, 30, 30, 38]), np.array([0, 8, 25, 30, 38, 55]))
    assert (x[:3] == x[3:]).all() and len(set(x[:3].tolist())) == 3


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.001"
    got = m.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 and not base_failed and not kept").count() == 0
