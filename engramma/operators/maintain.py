"""Writes that follow from likeness, and the maintenance chain: links of new rows, updates, learnt rules, sleep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators import graph, ingest, lifecycle

#: Fixed values of the write path.
LINK_SIM, HINT_SIM, UPDATE_SIM, LEARN_SIM = 0.58, 0.72, 0.60, 0.90
NEAR_PER_WRITE, NEAR_FROM, RULE_IMPORTANCE = 4, 6, 0.95
KINDS = ("regla", "preferencia", "decision", "leccion")


def lexical_links(pairs: DataFrame) -> DataFrame:
    """Links from similar pairs (id, other, sim): newer to older, as strong as alike."""
    return pairs.where((F.col("sim") >= LINK_SIM) & (F.col("other") < F.col("id"))).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("sim").alias("weight"), F.lit("lexical").alias("type"), F.lit("confirmed").alias("status"))


def near_links(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """Nearest links woven at writing: each row's best earlier ones, once enough rows are there."""
    # how many rows were there before each one: ranks of ids, counted by range and not in one window
    before = pairs.join(active.select(F.col("id").alias("a")), F.col("other") == F.col("a"), "left_semi").where("other < id")
    enough = before.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= NEAR_FROM)
    top = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    best = before.join(enough.select("id"), "id").withColumn("r", F.row_number().over(top)).where(F.col("r") <= NEAR_PER_WRITE)
    return best.select(F.col("other").alias("src"), F.col("id").alias("dst"), F.col("sim").alias("weight"), F.lit("knn").alias("type"), F.lit("confirmed").alias("status"))


def supersede_hints(pairs: DataFrame) -> DataFrame:
    """For each new row the earlier one it may replace."""
    best = pairs.where("other < id").groupBy("id").agg(F.max(F.struct("sim", (-F.col("other")).alias("m"))).alias("b"))
    return best.where(F.col("b.sim") >= HINT_SIM).select("id", (-F.col("b.m")).alias("hint"), F.col("b.sim").alias("sim"))


def update(memories: DataFrame, requests: DataFrame, matches: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """New rows for requests (request, text, memory_id or null), and `update` links to what they replace.

    matches (request, id, sim) are candidates for requests without an id; only own rows that
    are not superseded count, and a replaced row is marked only if the match is reliable."""
    alive = memories.where("not superseded").select("id")
    best = matches.join(alive, "id").groupBy("request").agg(F.max(F.struct("sim", (-F.col("id")).alias("m"))).alias("b")).select("request", (-F.col("b.m")).alias("found"), F.col("b.sim").alias("sim"))
    named = requests.join(alive.select(F.col("id").alias("own")), F.col("memory_id") == F.col("own"), "left")
    target = named.join(best, "request", "left").select("request", "text", F.coalesce("own", F.when(F.col("memory_id").isNull() & (F.col("sim") >= UPDATE_SIM), F.col("found"))).alias("target"))
    fresh = target.select("request", "text", F.lit("episodic").alias("kind"), F.lit(1.0).alias("novelty"), F.lit(0.7).alias("importance"), F.lit(0.75).alias("confidence"), F.lit(1.0).alias("strength"),
                          F.lit(0).cast("long").alias("access_count"), F.lit(now).alias("created"), F.lit(now).alias("last_access"), *[F.lit(False).alias(c) for c in ("consolidated", "superseded", "dormant")])
    marked = lifecycle.mark(memories, target.where("target is not null").select(F.col("target").alias("id")), "superseded")
    grown = lifecycle.append(marked, fresh, "request")
    links = grown.where("request is not null").select("id", "request").join(target.where("target is not null").select("request", "target"), "request")
    return grown.drop("request"), links.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("weight"), F.lit("update").alias("type"), F.lit("confirmed").alias("status"))


def learn(rules: DataFrame, new: DataFrame, pairs: DataFrame, now: float) -> DataFrame:
    """Rules of one's own name space with new ones (rule, kind, text): one that is known is touched instead.

    pairs (rule, id, sim) compare new ones with known ones."""
    if new.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).limit(1).count():
        raise ValueError("unknown kind of rule")
    known = pairs.where(F.col("sim") >= LEARN_SIM).groupBy("rule").agg(F.max(F.struct("sim", (-F.col("id")).alias("m"))).alias("b")).select("rule", (-F.col("b.m")).alias("id"))
    touched = lifecycle.touch(rules, known.select("id"), now)
    fresh = new.join(known, "rule", "left_anti").select("rule", "kind", "text", F.lit("__self__").alias("namespace"), F.lit(RULE_IMPORTANCE).alias("importance"), F.lit(1.0).alias("strength"), F.lit(0).cast("long").alias("access_count"), F.lit(now).alias("created"), F.lit(now).alias("last_access"))
    return lifecycle.append(touched, fresh, "rule").drop("rule")


def unlearn(memories: DataFrame, links: DataFrame, ids: DataFrame, space: str = "__self__") -> tuple[DataFrame, DataFrame]:
    """Without the named rules, and without their links; ids of other name spaces are ignored. Older snapshots hold them until vacuumed."""
    own = memories.where(F.col("namespace") == space).join(ids.select("id").distinct(), "id", "left_semi")
    return lifecycle.delete(memories, links, own)


def autosleep(meta: DataFrame, writes: DataFrame, every: int = 50) -> tuple[DataFrame, DataFrame]:
    """Counters of writes by name space, and the name spaces that are due to sleep.

    meta (namespace, key, value) holds the counter `writes`; writes (namespace) are new rows. The counter starts again only by `slept`, when the sleep succeeded."""
    new = writes.groupBy("namespace").agg(F.count("*").alias("n"))
    counter = meta.where("key = 'writes'").select("namespace", F.col("value").cast("long").alias("was"))
    both = counter.join(new, "namespace", "full").select("namespace", (F.coalesce("was", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("total"))
    kept = meta.where("key <> 'writes'").select("namespace", "key", "value")
    rows = both.select("namespace", F.lit("writes").alias("key"), F.col("total").cast("string").alias("value"))
    return kept.unionByName(rows), both.where(F.col("total") >= every).select("namespace")


def slept(meta: DataFrame, spaces: DataFrame) -> DataFrame:
    """Counters of the named name spaces at zero."""
    named = spaces.select(F.col("namespace").alias("done")).distinct()
    hit = F.col("done").isNotNull() & (F.col("key") == "writes")
    return meta.join(named, F.col("namespace") == F.col("done"), "left").select("namespace", "key", F.when(hit, "0").otherwise(F.col("value")).alias("value"))


def sleep(memories: DataFrame, links: DataFrame, now: float, similarity, bridges: int = 5, summarizer=None) -> dict[str, DataFrame]:
    """Consolidate, forget, dream: new memories, groups, and proposed bridges. memories need hv, which `similarity` of a dream may read."""
    eps = memories.where("kind = 'episodic' and not consolidated and not dormant")
    groups = ingest.consolidate(eps, summarizer)
    members = groups.select(F.explode("members").alias("id"))
    marked = lifecycle.mark(memories, members, "consolidated")
    fresh = groups.select("first_id", "namespace", "text", "hv", "importance", "confidence", "novelty", F.lit("semantic").alias("kind"), F.lit(1.0).alias("strength"), F.lit(0).cast("long").alias("access_count"),
                          F.lit(now).alias("created"), F.lit(now).alias("last_access"), *[F.lit(False).alias(c) for c in ("consolidated", "superseded", "dormant")])
    grown = lifecycle.append(marked, fresh, "first_id")
    forgotten = lifecycle.forget(grown.drop("first_id"), now).drop("forgotten")
    new_ids = grown.where("first_id is not null").select("first_id", F.col("id").alias("src"))
    inherited = ingest.inherit(groups, graph.neighbours(links)).join(new_ids, "first_id").select("src", "dst", "weight", F.lit("consolidation").alias("type"), F.lit("confirmed").alias("status"))
    nodes = forgotten.where("not superseded").select("id", "confidence", "dormant", "hv")
    dreams = graph.dream(nodes, graph.neighbours(links.select(inherited.columns).unionByName(inherited)), similarity, bridges)
    proposed = dreams.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.lit(0.5).alias("weight"), F.lit("dream").alias("type"), F.lit("proposed").alias("status"))
    return {"memories": forgotten, "groups": groups, "links": links.select(inherited.columns).unionByName(inherited).unionByName(proposed), "bridges": dreams}
