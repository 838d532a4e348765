import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from engramma.functions import hv
from engramma.operators import graph, navigate
from engramma.sources import snapshots
from tests.unit.test_engine import memories, rows
from tests.unit.test_navigate import whole

SF = "/root/testdata/sf0.01"


def stored(spark, vectors):
    extra = memories(spark, [dict(id=-1)]).drop("hv", "id")
    return vectors.select("id", "hv").crossJoin(extra).select("id", "hv", *extra.columns)


def test_stored_index_finds_what_a_scan_finds(spark):
    ids, sims = whole(SF)
    got = __spark_entry__.queries()["r18_navigate_stored"](spark, SF).collect()
    want = {(int(q), int(ids[j])) for q, row in zip(ids, sims, strict=True) if q % 50 == 0 for j in np.lexsort((ids, -row))[:5]}
    assert len(want & {(r.query_id, r.id) for r in got}) / len(want) >= 0.9


def test_index_is_read_extended_and_kept_by_vacuum(spark, tmp_path):
    vectors, _ = navigate.clustered(spark, 6, 20)
    vectors = snapshots.checkpointed(vectors)
    store = snapshots.Store(spark, str(tmp_path / "s"))
    store.commit(memories=stored(spark, vectors.where("id % 4 <> 1")))
    assert navigate.indexed(store)[2] == {"step": "built", "touched": 90} and store.current() == 2
    assert navigate.indexed(store)[2] == {"step": "read", "touched": 0} and store.current() == 2
    old = snapshots.checkpointed(store.index()["links"])
    store.apply({"memories": stored(spark, vectors.where("id % 4 = 1"))}, {"memories": spark.range(0, 3, 2)})
    nodes, links, done = navigate.indexed(store)
    assert done == {"step": "extended", "touched": 30} and nodes.count() == 118
    assert links.where("src in (0, 2) or dst in (0, 2)").count() == 0
    kept = links.where("src % 4 <> 1 and dst % 4 <> 1").select("src", "dst")
    assert kept.subtract(old.select("src", "dst")).count() == 0  # no link between old rows is new
    assert graph.degrees(graph.neighbours(links.withColumns({"type": F.lit("knn"), "status": F.lit("confirmed")}))).agg(F.max("degree")).first()[0] <= navigate.DEGREE
    store.vacuum()
    assert navigate.indexed(store)[2]["step"] == "read" and store.versions() == [4]
    asks = vectors.where("id % 4 = 1").select(F.col("id").alias("query_id"), "hv")
    again = navigate.search(nodes, links, asks, 3)
    fresh = navigate.search(nodes, navigate.links_of(nodes), asks, 3)
    same = again.select("query_id", "id").intersect(fresh.select("query_id", "id")).count()
    assert same >= 0.9 * fresh.count()


def test_changed_vectors_are_linked_anew(spark, tmp_path):
    vectors, _ = navigate.clustered(spark, 4, 15)
    store = snapshots.Store(spark, str(tmp_path / "s"))
    store.commit(memories=stored(spark, vectors))
    navigate.indexed(store)
    moved = spark.createDataFrame([(7, bytearray(hv.random_hv(2).tobytes()))], "id long, hv binary")  # into the third group
    store.apply({"memories": stored(spark, moved)})
    _, links, done = navigate.indexed(store)
    assert done == {"step": "extended", "touched": 1}
    ends = rows(links.where("src = 7 or dst = 7").select(F.when(F.col("src") == 7, F.col("dst")).otherwise(F.col("src"))))
    assert len(ends) == 12 and all(30 <= e[0] < 45 for e in ends)
