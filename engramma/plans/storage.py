"""Registered queries of the store: what is written from the given tables, as versions, deltas, backups, JSON, logs and conversation sets, is what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.functions import hv
from engramma.operators import context, graph, lifecycle, maintain, navigate
from engramma.plans import model as m
from engramma.plans.catalog import flat, query, r9
from engramma.plans.model import LNK, LOG, MEM, NEI, NOW, read
from engramma.sources import snapshots
from engramma.sources.snapshots import Store, checkpointed, fresh_place
from engramma.streaming import gate

FLAT = "id, namespace, kind, round(strength, 9) strength, access_count, consolidated, superseded, dormant"


def _memories(spark, d) -> DataFrame:
    """Documents as rows of the store's schema."""
    return m.memories(spark, d).withColumn("namespace", F.coalesce("namespace", F.lit(""))).withColumn("hv", F.lit(None).cast("binary")).select(*T.StructType.fromDDL(snapshots.MEMORIES).fieldNames())


def _links(spark, d) -> DataFrame:
    return m.links(spark, d).withColumns({"namespace": F.lit("main"), "created_at": F.lit(NOW)}).select(*T.StructType.fromDDL(snapshots.LINKS).fieldNames())


def _store(spark, d, links: bool = False) -> Store:
    store = Store(spark, fresh_place(spark))
    store.commit(memories=_memories(spark, d), **({"links": _links(spark, d)} if links else {}))
    return store


def _touch(ids: DataFrame):
    return lambda rows: lifecycle.touch(rows, ids, NOW + 1)


_NS = MEM.replace("lang namespace", "coalesce(lang, '') namespace")


@query("u3_touch_delta", f"""with {_NS} select {FLAT.replace('round(strength, 9) strength, access_count', "round(case when id % 50 = 0 then strength + 0.5 + case when id % 100 = 0 then 0.5 else 0 end else strength end, 9) strength, access_count + case when id % 100 = 0 then 2 when id % 50 = 0 then 1 else 0 end access_count")} from mem where id % 70 <> 0""")
def _(spark, d):
    """Two touches and a deletion, each a delta, laid over the rows on reading."""
    store = _store(spark, d)
    for step in (50, 100):
        ids = _memories(spark, d).where(F.col("id") % step == 0).select("id")
        store.mutate("memories", ids, _touch(ids))
    store.apply(deletes={"memories": _memories(spark, d).where("id % 70 = 0").select("id")})
    return flat(store.table("memories"))


@query("u3_delta_rows", "select 2::bigint version, count(*)::bigint n from documents where doc_id % 50 = 0 union all select 3, count(*) from documents where doc_id % 70 = 0")
def _(spark, d):
    """How many rows a change writes: as many as it changes."""
    store = _store(spark, d)
    ids = _memories(spark, d).where("id % 50 = 0").select("id")
    store.mutate("memories", ids, _touch(ids))
    store.apply(deletes={"memories": _memories(spark, d).where("id % 70 = 0").select("id")})
    deltas = store._manifest(3)["tables"]["memories"]["deltas"]
    one = lambda i: spark.read.parquet(deltas[i]["place"]).agg(F.lit(i + 2).cast("long").alias("version"), F.count("*").alias("n"))
    return one(0).unionByName(one(1))


@query("s9_time_travel", f"""with {_NS} select 1::bigint version, count(*)::bigint n, sum(access_count)::bigint accesses from mem union all select 2, count(*), sum(access_count + (id % 50 = 0)::int) from mem
  union all select 3, count(*), sum(access_count + (id % 50 = 0)::int) from mem where id % 70 <> 0""")
def _(spark, d):
    """Each version as it was."""
    store = _store(spark, d)
    ids = _memories(spark, d).where("id % 50 = 0").select("id")
    store.mutate("memories", ids, _touch(ids))
    store.apply(deletes={"memories": _memories(spark, d).where("id % 70 = 0").select("id")})
    out = None
    for version in store.versions():
        one = store.table("memories", version).agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n"), F.sum("access_count").alias("accesses"))
        out = one if out is None else out.unionByName(one)
    return out


@query("u9_vacuum", f"with {_NS} select 1::bigint versions, 1::bigint folders, count(*)::bigint n, sum(access_count + (id % 50 = 0)::int)::bigint accesses from mem")
def _(spark, d):
    """Deltas compacted into a whole table, older versions and their files gone."""
    store = _store(spark, d)
    ids = _memories(spark, d).where("id % 50 = 0").select("id")
    store.mutate("memories", ids, _touch(ids))
    store.compact()
    store.vacuum()
    folders = len(store._where(store.current())["memories"])
    return store.table("memories").agg(F.lit(len(store.versions())).cast("long").alias("versions"), F.lit(folders).cast("long").alias("folders"), F.count("*").alias("n"), F.sum("access_count").alias("accesses"))


@query("u8_erase", f"""with {_NS}, {LNK}, dead as (select doc_id from labels where toxic = 1 and doc_id is not null)
select 'memories' "table", count(*)::bigint n from mem where id not in (from dead) union all select 'links', count(*) from lnk where src not in (from dead) and dst not in (from dead)""")
def _(spark, d):
    """Toxic documents erased: what all files under the store still hold."""
    store = _store(spark, d, links=True)
    store.mutate("memories", (ids := _memories(spark, d).where("id % 50 = 0").select("id")), _touch(ids))
    store.erase(read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    files = spark.read.option("recursiveFileLookup", "true")
    count = lambda name: files.parquet(f"{store.root}/data/*/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n"))
    return count("memories").unionByName(count("links"))


@query("s16_backup", f"with {_NS} select {FLAT} from mem")
def _(spark, d):
    """Rows deleted by mistake, brought back from a backup."""
    store = _store(spark, d)
    backup = fresh_place(spark)
    store.backup(backup)
    store.apply(deletes={"memories": _memories(spark, d).where("id % 2 = 0").select("id")})
    store.restore(backup)
    return flat(store.table("memories"))


@query("u16_all_or_nothing", f"with {_NS} select true refused, 2::bigint version, count(*)::bigint n, sum(access_count + (id % 50 = 0)::int)::bigint accesses from mem")
def _(spark, d):
    """A second writer from the same version is refused and leaves nothing."""
    store = _store(spark, d)
    other, base = Store(spark, store.root), store.current()
    ids = _memories(spark, d).where("id % 50 = 0").select("id")
    store.mutate("memories", ids, _touch(ids))
    try:
        other.apply(deletes={"memories": ids}, base=base)
        refused = False
    except RuntimeError:
        refused = True
    return store.table("memories").agg(F.lit(refused).alias("refused"), F.lit(store.current()).cast("long").alias("version"), F.count("*").alias("n"), F.sum("access_count").alias("accesses"))


@query("u18_health", f"""with {_NS}, {LNK} select 'memories' "table", count(*)::bigint n, true ok from mem union all select 'links', count(*), true from lnk""")
def _(spark, d):
    state = _store(spark, d, links=True).health()
    return spark.createDataFrame([(name, n, state["ok"] and state["writable"]) for name, n in state["rows"].items()], '`table` string, n long, ok boolean')  # a row for each table


@query("u19_migrate", f"""with {LNK} select src, dst, round(weight, 9) weight, 'lexical' "type", case when status in ('confirmed', 'proposed', 'rejected') and src % 5 > 0 then status else 'confirmed' end status, 'default' namespace from lnk""")
def _(spark, d):
    """Links of an older schema, without types and with states that are none, brought to the current one."""
    store = Store(spark, fresh_place(spark))
    old = m.links(spark, d).select("src", "dst", "weight", F.when(F.col("src") % 5 == 0, "odd").otherwise(F.col("status")).alias("status"))
    now, snapshots.SCHEMA_VERSION = snapshots.SCHEMA_VERSION, 4
    try:
        store.commit(links=old)
    finally:
        snapshots.SCHEMA_VERSION = now
    store.migrate()
    return store.table("links").select("src", "dst", r9("weight"), "type", "status", "namespace")


@query("s13_json", f"with {_NS} select id, namespace, kind, dormant, fact_id, length(text)::bigint size from mem")
def _(spark, d):
    """A view written as JSON lines and read back: nulls and line breaks in texts included."""
    folder = fresh_place(spark)
    snapshots.write_json({"list": _memories(spark, d).select("id", "namespace", "kind", "dormant", "fact_id", "text")}, folder)
    got = spark.read.schema("id long, namespace string, kind string, dormant boolean, fact_id long, text string").json(f"{folder}/list")
    return got.select("id", "namespace", "kind", "dormant", "fact_id", F.length("text").cast("long").alias("size"))


@query("s13_text", f"with {LOG} select substr(line, 1, 19) ts, split_part(substr(line, 21), ' ', 1) \"action\", trim(substr(line, 31)) detail from lg")
def _(spark, d):
    """A decision log written as text, in order, and read as a log."""
    folder = fresh_place(spark)
    snapshots.write_text(m.log_lines(spark, d).select("line_no", "line"), folder)
    return snapshots.read_log(spark, folder).select("ts", "action", "detail")


@query("s14_sessions", """with q as (select item_id, text from benchmark), c as (select * from conversations)
select 'q' || item_id || case when item_id % 7 = 0 then '_abs' else '' end question_id, 's' || conv_id session_id, conv_id % 11 = item_id % 11 holds_answer, row_number() over (partition by item_id, conv_id order by turn)::int - 1 turn, role, length(c.text)::bigint size, item_id % 7 = 0 unanswerable
from q join c on conv_id % 5 = item_id % 5""")
def _(spark, d):
    """Conversations written as sets, a file a question, and read back turn by turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    sessions = read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    item = F.col("item_id")
    asked = read(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.concat(F.lit("q"), item.cast("string"), F.when(item % 7 == 0, "_abs").otherwise("")).alias("question_id"))
    both = asked.join(sessions, F.col("conv_id") % 5 == item % 5)
    name = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    right = F.collect_list(F.when(F.col("conv_id") % 11 == item % 11, name))
    sets = both.groupBy("item_id", "question_id", "question").agg(F.collect_list(name).alias("haystack_session_ids"), F.collect_list("turns").alias("haystack_sessions"), right.alias("answer_session_ids"))
    sets = sets.withColumns({"question_type": F.lit("single"), "answer": F.lit("")})
    folder = fresh_place(spark)
    body = F.to_json(F.array(F.struct("question_id", "question_type", "question", "answer", "haystack_session_ids", "haystack_sessions", "answer_session_ids")))
    sets.select("item_id", body.alias("value")).write.partitionBy("item_id").text(folder)
    got = snapshots.read_sessions(spark, f"{folder}/*")
    return got.select("question_id", "session_id", "holds_answer", "turn", "role", F.length("text").cast("long").alias("size"), "unanswerable")


@query("b2_budgets", """select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_size end, try_cast(case when p_partkey % 2 = 0 then p_brand else p_size || ' ' end as bigint), 350)::bigint budget from part""")
def _(spark, d):
    """Budgets by precedence: an environment's value, a stored one, the default; what is no number counts as unset."""
    size = F.col("p_size").cast("string")
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, size).alias("environment"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(size, F.lit(" "))).alias("stored"))
    return p.select("p_partkey", context.budgets(F.col("environment"), F.col("stored")).alias("budget"))


@query("w18_autosleep", """with w as (select role, count(*) n from conversations group by 1) select role namespace, (n + 30)::bigint total, n + 30 >= 50 due, case when n + 30 >= 50 then 0 else n + 30 end::bigint afterwards from w""")
def _(spark, d):
    """Counters of writes by name space (30 were there), who is due to sleep, and the counters once they slept."""
    writes = m.turns(spark, d).select(F.col("role").alias("namespace"))
    meta = writes.distinct().select("namespace", F.lit("writes").alias("key"), F.lit("30").alias("value"))
    counted, due = maintain.autosleep(meta, writes)
    after = maintain.slept(counted, due).select("namespace", F.col("value").cast("long").alias("afterwards"))
    both = counted.select("namespace", F.col("value").cast("long").alias("total")).join(due.withColumn("due", F.lit(True)), "namespace", "left")
    return both.join(after, "namespace").select("namespace", "total", F.coalesce("due", F.lit(False)).alias("due"), "afterwards")


@query("w2_admit_stream")
def _(spark, d):
    """Turns as a stream of files, admitted by keyed state, written to the store batch by batch; what the store's log of scores then holds, with the decisions."""
    own = spark.newSession()  # the provider of the state is this session's alone
    own.conf.set(*gate.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    source, out, state = fresh_place(spark), fresh_place(spark), fresh_place(spark)
    turns = m.turns(spark, d).select(F.col("role").alias("namespace"), "seq", "text")
    cuts = [None, *turns.approxQuantile("seq", [0.3, 0.7], 0.05), None]
    for low, high in zip(cuts, cuts[1:], strict=False):  # three files, one after another in order of seq
        part = turns.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = own.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = gate.admit_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(gate.DECISIONS).parquet(out).select("namespace", "seq", "novelty", "predictable", "stored", "reinforces")


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """Embeddings as rows of the store, and the dense vectors they are signs of."""
    dense = read(spark, d, "embeddings").where("embedding is not null").withColumnRenamed("vec_id", "id")
    rows = dense.select("id", hv.simhash_udf("embedding").alias("hv"), F.lit("main").alias("namespace"))
    rows = checkpointed(snapshots.evolved("memories", rows).select(*T.StructType.fromDDL(snapshots.MEMORIES).fieldNames()))
    return rows, checkpointed(dense.select("id", hv.unit_udf("embedding").alias("unit")))


def _grown(spark, d) -> tuple[Store, list[dict], DataFrame]:
    """A store whose index is built over nine tenths of the vectors, read, and brought up to date when the rest arrives."""
    rows, units = _vectors(spark, d)
    store = Store(spark, fresh_place(spark))
    store.commit(memories=rows.where("id % 10 <> 3"))
    steps = [navigate.indexed(store, units)[2], navigate.indexed(store, units)[2]]
    store.apply({"memories": rows.where("id % 10 = 3")})
    steps.append(navigate.indexed(store, units)[2])
    return store, steps, rows


@query("r18_index_steps", """select 'built' step, 0 place, count(*) filter (vec_id % 10 <> 3)::bigint touched, count(*)::bigint nodes from embeddings where embedding is not null union all select 'read', 1, 0, count(*) from embeddings where embedding is not null
  union all select 'extended', 2, count(*) filter (vec_id % 10 = 3), count(*) from embeddings where embedding is not null""")
def _(spark, d):
    """What each use of the stored index compared: all rows, none, the new ones."""
    store, steps, _ = _grown(spark, d)
    nodes = store.index()["nodes"].count()
    return spark.createDataFrame([(s["step"], i, s["touched"], nodes) for i, s in enumerate(steps)], "step string, place int, touched long, nodes long")  # three rows


@query("r18_navigate_stored")
def _(spark, d):
    """The queries of r13_navigate through the stored index after it grew."""
    store, _, rows = _grown(spark, d)
    vectors, links, _ = navigate.indexed(store)
    asks = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "hv")
    return navigate.search(vectors, links, asks, 5)


@query("r17_layout", f"with {LNK}, {NEI} select node, list(other order by other) others, count(*)::bigint degree, (16 + 8 * count(*))::bigint bytes from nei group by 1")
def _(spark, d):
    """The graph as one row of neighbours a node, and what it takes."""
    return graph.adjacency(graph.neighbours(m.links(spark, d))).select("node", "others", "degree", "bytes")
