import random

import numpy as np
import pytest

import __spark_entry__
from engramma.functions import hv
from engramma.operators import ingest
from tests.unit.test_write_path import one_by_one


def drifting(rng, n, step):
    """Vectors that each differ from the one before in `step` bits, and copies of some."""
    bits = hv.random_bits(rng.randrange(1000))
    out = []
    for _ in range(n):
        bits = bits.copy()
        bits[rng.sample(range(hv.BITS), step)] ^= 1
        out.append(np.packbits(bits))
        if rng.random() < 0.3:
            out.append(rng.choice(out))
    return out


@pytest.mark.parametrize(("tables", "block"), [(1, 2048), (48, 3), (1, 3)])
def test_missed_pairs_and_rounds_change_nothing(spark, monkeypatch, tables, block):
    """One table of sampled bits misses most pairs; blocks of three leave all to the rounds: a chain in which each row depends on the one before."""
    rng = random.Random(4)
    vectors = drifting(rng, 14, 250) + drifting(rng, 8, 590)
    rng.shuffle(vectors)
    rows = [(10 + i, rng.choice("ab"), v) for i, v in enumerate(vectors)]
    flags = [rng.random() < 0.15 for _ in rows]
    monkeypatch.setattr(ingest, "TABLES", tables)
    monkeypatch.setattr(ingest, "BLOCK", block)
    obs = spark.createDataFrame([(ns, s, v.tobytes()) for s, ns, v in rows], "namespace string, seq long, hv binary")
    said = spark.createDataFrame([(ns, s, f) for (s, ns, _), f in zip(rows, flags, strict=True)], "namespace string, seq long, predictable boolean")
    reads = spark.createDataFrame([("a", "b")], "namespace string, reads string")
    got = sorted((r.seq, r.novelty, r.stored, r.reinforces) for r in ingest.admit(obs, None, reads, said).collect())
    assert got == one_by_one(rows, (), {"a": {"b"}}, flags)
    assert len({s for _, _, s, _ in got}) == 2


def test_both_vetoes_act_on_documents_with_copies(spark):
    got = __spark_entry__.queries()["w2_admit_copies"](spark, "/root/testdata/sf0.01").collect()
    alike = [r for r in got if r.reinforces is not None]
    dull = [r for r in got if r.reinforces is None and not r.stored]
    assert len(alike) > 20 and len(dull) > 20 and not any(r.stored for r in alike)


def test_nothing_to_admit(spark):
    empty = spark.createDataFrame([], "namespace string, seq long, text string")
    assert ingest.admit(empty).collect() == []
