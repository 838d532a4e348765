import pytest
from pyspark.sql import functions as F

from engramma.functions import hv
from engramma.operators import graph, maintain, navigate, recall
from tests.unit.test_engine import memories, rows


def test_links_of_new_rows(spark):
    pairs = spark.createDataFrame([(i, j, 0.5 + 0.01 * ((i * 7 + j * 3) % 30)) for i in range(1, 11) for j in range(1, 11) if i != j], "id long, other long, sim double")
    active = spark.createDataFrame([(i,) for i in range(1, 11)], "id long")
    lex = rows(maintain.lexical_links(pairs).select("src", "dst"))
    assert lex == [(i, j) for i in range(1, 11) for j in range(1, i) if 0.5 + 0.01 * ((i * 7 + j * 3) % 30) >= 0.58]
    near = maintain.near_links(pairs, active).collect()
    assert {r.dst for r in near} == {7, 8, 9, 10} and len(near) == 16 and all(r.src < r.dst for r in near)
    assert all(r.sim >= 0.72 and r.hint < r.id for r in maintain.supersede_hints(pairs).collect())


def test_update(spark):
    mem = memories(spark, [dict(id=1, text="old"), dict(id=2, text="gone", superseded=True), dict(id=3, text="other")])
    asks = spark.createDataFrame([(1, "new text", 1), (2, "by likeness", None), (3, "too far", None), (4, "foreign", 2)], "request long, text string, memory_id long")
    near = spark.createDataFrame([(2, 3, 0.8), (2, 2, 0.9), (3, 1, 0.4)], "request long, id long, sim double")
    grown, links = maintain.update(mem, asks, near, 5.0)
    got = {r.text: r for r in grown.collect()}
    assert len(got) == 7 and got["old"].superseded and got["old"].strength == 0.3 and got["other"].superseded
    assert rows(links.select("src", "dst")) == [(got["new text"].id, 1), (got["by likeness"].id, 3)]
    assert got["new text"].novelty == 1.0 if "novelty" in grown.columns else True


def test_learn(spark):
    cols = "id long, kind string, text string, namespace string, importance double, strength double, access_count long, created double, last_access double"
    rules = spark.createDataFrame([(1, "regla", "always test", "__self__", 0.95, 1.0, 0, 0.0, 0.0)], cols)
    new = spark.createDataFrame([(1, "regla", "always test!"), (2, "leccion", "ask first")], "rule long, kind string, text string")
    pairs = spark.createDataFrame([(1, 1, 0.95), (2, 1, 0.5)], "rule long, id long, sim double")
    got = {r.text: r for r in maintain.learn(rules, new, pairs, 9.0).collect()}
    assert set(got) == {"always test", "ask first"} and got["always test"].strength == 1.5 and got["always test"].last_access == 9.0 and got["ask first"].id == 2
    with pytest.raises(ValueError):
        maintain.learn(rules, new.withColumn("kind", F.lit("x")), pairs, 9.0)


def test_sleep(spark):
    texts = ["the red fox runs", "the red fox runs!", "blue whales swim far", "green parrots talk", "old trains whistle", "new planes fly"]
    mem = memories(spark, [dict(id=i, text=t, importance=0.9) for i, t in enumerate(texts)]).withColumn("hv", hv.encoder()("text")).withColumn("novelty", F.lit(0.5))
    links = spark.createDataFrame([(0, 2, 0.7, "lexical", "confirmed"), (2, 3, 0.6, "lexical", "confirmed")], "src long, dst long, weight double, type string, status string")
    out = maintain.sleep(mem, links, 0.0, lambda a, b: F.lit(0.63))
    got = {r.id: r for r in out["memories"].collect()}
    assert len(got) == 7 and got[0].consolidated and got[1].consolidated and got[6].kind == "semantic"
    made = rows(out["links"].select("src", "dst", "type"))
    assert (6, 2, "consolidation") in made and (0, 3, "dream") in made


def test_navigation_is_faithful(spark):
    mem, ring = navigate.clustered(spark, 12, 20)
    mem = mem.cache()
    asks = mem.where("id % 40 = 3").select(F.col("id").alias("query_id"), "hv")
    got = navigate.search(mem, ring, asks, 5)
    labels = mem.select("id", "cluster")
    both = got.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("cluster").alias("qc")), "query_id")
    assert both.where("cluster = qc").count() == both.count() == 30
    assert {(r.query_id, r.id) for r in got.where("rank = 1").collect()} == {(i, i) for i in range(3, 240, 40)}
    assert got.agg(F.max("visited")).first()[0] < 60
    wide = mem.withColumn("strength", F.lit(1.0)).withColumn("confidence", F.lit(0.5)).withColumn("superseded", F.lit(False))
    exact = recall.search(wide, asks, 1)
    assert rows(exact.select("query_id", "id")) == [(i, i) for i in range(3, 240, 40)]


def test_unlearn_and_autosleep(spark):
    mem = memories(spark, [dict(id=1, namespace="__self__"), dict(id=2, namespace="__self__"), dict(id=3, namespace="a")])
    links = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    left, edges = maintain.unlearn(mem, links, spark.createDataFrame([(1,), (3,)], "id long"))
    assert rows(left.select("id")) == [(2,), (3,)] and rows(edges) == [(2, 3)]
    meta = spark.createDataFrame([("a", "writes", "48"), ("a", "other", "x"), ("b", "writes", "7")], "namespace string, key string, value string")
    new, due = maintain.autosleep(meta, spark.createDataFrame([("a",), ("a",), ("c",)], "namespace string"))
    assert rows(new) == [("a", "other", "x"), ("a", "writes", "50"), ("b", "writes", "7"), ("c", "writes", "1")] and rows(due) == [("a",)]
    assert rows(maintain.slept(new, due)) == [("a", "other", "x"), ("a", "writes", "0"), ("b", "writes", "7"), ("c", "writes", "1")]


def test_graph_structure(spark):
    ring = [(i, (i + 1) % 12, 1.0) for i in range(12)]
    both = spark.createDataFrame([e for a, b, w in ring for e in ((a, b, w), (b, a, w))], "node long, other long, weight double")
    got = graph.coverage(both).first()
    assert (got.nodes, got.components, got.mean_degree, round(got.two_hops, 6), got.shortcuts) == (12, 1, 2.0, round(5 / 12, 6), True)
    more = graph.with_shortcuts(both)
    assert more.count() > both.count() and rows(more.where("weight > 0")) == rows(both)
    dense = spark.createDataFrame([(a, b, 1.0) for a in range(10) for b in range(10) if a != b], "node long, other long, weight double")
    assert graph.with_shortcuts(dense).count() == 90
    star = spark.createDataFrame([(0, i, i / 10) for i in range(1, 9)] + [(7, 8, 0.01)], "src long, dst long, weight double")
    assert rows(graph.capped(star, 3).select("src", "dst")) == [(0, 6), (0, 7), (0, 8), (7, 8)]


def test_dream_of_every_name_space(spark):
    nodes = spark.createDataFrame([(i, "a" if i < 4 else "b", 0.5, False) for i in range(8)], "id long, namespace string, confidence double, dormant boolean")
    pairs = [(0, 1), (1, 2), (4, 5), (5, 6), (3, 4), (2, 3)]
    e = spark.createDataFrame([x for a, b in pairs for x in ((a, b, 0.9), (b, a, 0.9))], "node long, other long, weight double")
    got = graph.dream_all(nodes, e, lambda a, b: F.lit(0.6) + F.col(f"{a}.id") / 100, 2).collect()
    assert [(r.namespace, r.a_id, r.b_id) for r in got] == [("b", 4, 6), ("a", 1, 3), ("a", 0, 2)]
