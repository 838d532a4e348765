import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from engramma.functions import hv
from engramma.operators import navigate


def whole(sf):
    """Ids of the embeddings table and all similarities of their hypervectors."""
    d = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    m = np.stack([hv.simhash(v) for v in d["embedding"]])
    return d["vec_id"].to_numpy(), np.stack([hv.similarity_batch(q, m) for q in m])


def recall_of_query(spark, sf):
    ids, sims = whole(sf)
    got = __spark_entry__.queries()["r13_navigate"](spark, sf).collect()
    want = {(int(q), int(ids[j])) for q, row in zip(ids, sims, strict=True) if q % 50 == 0 for j in np.lexsort((ids, -row))[:5]}
    return len(want & {(r.query_id, r.id) for r in got}) / len(want)


def test_registered_query_against_brute_force(spark):
    assert recall_of_query(spark, "/root/testdata/sf0.01") >= 0.9


def test_every_size_is_answered(spark):
    mem, ring = navigate.clustered(spark, 1, 3)
    asks = mem.select(F.col("id").alias("query_id"), "hv")
    got = navigate.search(mem, ring, asks, 5)
    assert got is not None and sorted((r.query_id, r.id) for r in got.collect()) == [(i, j) for i in range(3) for j in range(3)]
    assert navigate.search(mem.limit(0), ring.limit(0), asks, 5).count() == 0
    far, _ = navigate.clustered(spark, 4, 10)  # no links: not navigable
    got = navigate.search(far, ring.limit(0), far.where("id = 7").select(F.col("id").alias("query_id"), "hv"), 5).collect()
    assert len(got) == 5 and got[0].id == 7


def test_writes_over_whole_vectors(spark):
    sf = "/root/testdata/sf0.001"
    ids, sims = whole(sf)
    order = [[int(j) for j in np.lexsort((ids, -row)) if j != i] for i, row in enumerate(sims)]
    before = [[j for j in o if j < i] for i, o in enumerate(order)]  # ids ascend
    name = lambda i: int(ids[i])
    got = {n: {tuple(r)[:2] for r in __spark_entry__.queries()[f"{n}_whole"](spark, sf).collect()} for n in ("u13_reindex", "w4_lexical_links", "w5_near_links", "w6_supersede_hints")}
    assert got["u13_reindex"] == {(name(min(i, j)), name(max(i, j))) for i, o in enumerate(order) for j in o[:12]}
    assert got["w4_lexical_links"] == {(name(i), name(j)) for i, o in enumerate(before) for j in o if sims[i, j] >= 0.58}
    assert got["w5_near_links"] == {(name(j), name(i)) for i, o in enumerate(before) if len(o) >= 6 for j in o[:4]}
    assert got["w6_supersede_hints"] == {(name(i), name(o[0])) for i, o in enumerate(before) if o and sims[i, o[0]] >= 0.72}
