import pytest
from pyspark.sql import functions as F

from engramma.operators import lifecycle
from engramma.sources import snapshots
from engramma.streaming import gate
from tests.unit.test_engine import memories, rows


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def files_under(path):
    return sorted(p for p in path.rglob("*.parquet"))


def test_a_touch_writes_what_it_touches(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    store.commit(memories=memories(spark, [dict(id=i, namespace="ab"[i % 2]) for i in range(40)]))
    before = set(files_under(tmp_path))
    touched = ids(spark, *range(10))
    assert store.mutate("memories", touched, lambda df: lifecycle.touch(df, touched, 9.0)) == 2
    new = [p for p in files_under(tmp_path) if p not in before]
    assert spark.read.parquet(*map(str, new)).count() == 10
    got = {r.id: r for r in store.table("memories").collect()}
    assert len(got) == 40 and {i for i, r in got.items() if r.last_access == 9.0} == set(range(10))
    assert store.table("memories", 1).where("last_access = 9").count() == 0


def test_last_change_of_a_row_holds(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    assert store.apply({"memories": memories(spark, [dict(id=1, text="a"), dict(id=2, text="b")])}) == 1
    store.apply({"memories": memories(spark, [dict(id=1, text="c"), dict(id=3, text="d")])}, {"memories": ids(spark, 2)})
    store.apply(deletes={"memories": ids(spark, 1)})
    store.apply({"memories": memories(spark, [dict(id=1, text="e")])})
    assert rows(store.table("memories").select("id", "text")) == [(1, "e"), (3, "d")]
    assert [store.table("memories", v).count() for v in store.versions()] == [2, 2, 1, 2]
    with pytest.raises(ValueError, match="several changes"):
        store.apply({"memories": memories(spark, [dict(id=7), dict(id=7)])})
    assert store.current() == 4 and len(list((tmp_path / "s" / "data").iterdir())) == 4
    assert store.compact() == 5 and store.compact() is None and rows(store.table("memories").select("id", "text")) == [(1, "e"), (3, "d")]
    assert store.vacuum() == 4 and store.versions() == [5] and len(store._where(5)["memories"]) == 1


def test_many_deltas_are_written_whole(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    for i in range(5):
        store.apply({"meta": spark.createDataFrame([("n", f"k{i % 2}", str(i))], snapshots.META)}, most=3)
    assert rows(store.table("meta").select("key", "value")) == [("k0", "4"), ("k1", "3")]
    assert len(store._where(5)["meta"]) <= 4


def test_erased_rows_are_in_no_file(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    links = spark.createDataFrame([(1, 2, 0.5, "a", "knn", "confirmed", 0.0), (3, 4, 0.5, "a", "knn", "confirmed", 0.0)], snapshots.LINKS)
    store.commit(memories=memories(spark, [dict(id=i) for i in range(1, 5)]), links=links)
    store.apply({"memories": memories(spark, [dict(id=2, text="secret")])})
    store.erase(ids(spark, 2))
    every = spark.read.option("recursiveFileLookup", "true")
    assert rows(every.parquet(str(tmp_path / "s/data/*/memories")).select("id")) == [(1,), (3,), (4,)]
    assert rows(every.parquet(str(tmp_path / "s/data/*/links")).select("src", "dst")) == [(3, 4)]


def test_old_tables_carried_by_a_new_version_are_still_brought_up(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    now, snapshots.SCHEMA_VERSION = snapshots.SCHEMA_VERSION, 4
    try:
        store.commit(links=spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double"))
    finally:
        snapshots.SCHEMA_VERSION = now
    store.apply({"meta": spark.createDataFrame([("n", "k", "v")], snapshots.META)})
    assert rows(store.table("links").select("src", "type", "status")) == [(1, "lexical", "confirmed")]
    store.migrate()
    assert rows(store.table("links").select("src", "type", "namespace")) == [(1, "lexical", "default")] and store.migrate() is None


def test_scratch_deletes_what_the_result_does_not_read(spark):
    with snapshots.scratch(spark) as keep:
        a = snapshots.checkpointed(spark.range(5))
        got = keep(a.join(snapshots.checkpointed(spark.range(3)), "id"))
    assert got.count() == 3
    with pytest.raises(Exception, match="(?i)does not exist|not_exist"):
        a.count()


SCHEMA = "id long, namespace string, text string"


def test_a_stream_into_the_store_comes_once(spark, tmp_path):
    store, src = snapshots.Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    part = lambda a, b: memories(spark, [dict(id=i, text=f"t{i}") for i in range(a, b)]).drop("hv").coalesce(1).write.mode("append").parquet(src)
    part(0, 5)
    schema = spark.read.parquet(src).schema

    def run():
        q = gate.into_store(spark.readStream.schema(schema).parquet(src), store, "memories", "arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    part(5, 8)
    run()
    assert sorted(r.id for r in store.table("memories").collect()) == list(range(8)) and store.versions() == [1, 2]
    last = sorted((tmp_path / "c" / "commits").glob("[0-9]*"))[-1]
    last.unlink()  # as if it had died after writing and before saying so
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.id for r in store.table("memories").collect()) == list(range(8)) and store.versions() == [1, 2]


def test_a_restarted_stream_admits_as_the_batch_does(spark, tmp_path):
    from engramma.operators import ingest

    texts = [f"note {i % 9} about subject{i % 9} and thing{i % 9 * 7} in room{i % 9}" for i in range(60)] + ["", "one two three", "One two, three!"]
    data = [("ab"[i % 2], i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "namespace string, seq long, text string")
    src = tmp_path / "in"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for low, high in ((0, 20), (20, 45), (45, 99)):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").json(str(src))
        stream = gate.admit_stream(spark.readStream.schema(df.schema).json(str(src)), keep=4)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    columns = ["namespace", "seq", "novelty", "stored", "reinforces"]
    got = rows(spark.read.parquet(out).select(*columns))
    assert got == rows(ingest.admit(df).select(*columns)) and len({g[3] for g in got}) == 2
