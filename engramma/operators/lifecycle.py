"""Scans, mutations, forgetting and eviction over immutable snapshots of memories, links and facts.

Every operator returns new DataFrames; `sources.snapshots` persists them.  All orders end
in the id, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.operators.order import least_rows

#: Fixed values of the memory model.
HALF_LIFE_S, SEMANTIC_FACTOR = 14 * 86400.0, 5.0
FORGET_FLOOR, RETENTION_FLOOR, PROTECTED, UTILITY_CAP = 0.15, 0.40, 0.8, 5.0
SUPERSEDED_CAP, TOUCH, REINFORCE = 0.3, 0.5, 0.7


def readable(rows: DataFrame, own: str, linked: tuple[str, ...] = (), own_only: bool = False) -> DataFrame:
    """Rows of the readable name spaces: one's own, linked ones, or all but `__self__` for `*`."""
    if own_only or not linked:
        return rows.where(F.col("namespace") == own)
    if "*" in linked:
        return rows.where((F.col("namespace") == own) | (F.col("namespace") != "__self__"))
    return rows.where(F.col("namespace").isin(own, *linked))


def scan(memories: DataFrame, kind: str | None = None, only_active: bool = True, include_dormant: bool = False, limit: int | None = None) -> DataFrame:
    out = memories
    if kind:
        out = out.where(F.col("kind") == kind)
    if only_active:
        out = out.where(~F.col("consolidated"))
    if not include_dormant:
        out = out.where(~F.col("dormant"))
    return out.orderBy(F.desc("strength"), F.desc("last_access"), "id").limit(limit) if limit else out


def dump(memories: DataFrame, order: str = "recent", limit: int = 50) -> DataFrame:
    by = {"recent": "created", "importance": "importance", "access": "access_count", "created": "created"}[order]
    return memories.drop("hv").orderBy(F.desc(by), "id").limit(limit)


def utility() -> Column:
    return F.least(F.col("access_count").cast("double"), F.lit(UTILITY_CAP)) / UTILITY_CAP


def retention() -> Column:
    return 0.4 * F.col("importance") + 0.3 * F.col("confidence") + 0.3 * utility()


def decayed(now: float) -> Column:
    life = F.when(F.col("kind") == "semantic", HALF_LIFE_S * SEMANTIC_FACTOR).otherwise(HALF_LIFE_S)
    return F.col("strength") * F.pow(F.lit(0.5), (F.lit(now) - F.col("last_access")) / life)


def forget(memories: DataFrame, now: float, dry_run: bool = False) -> DataFrame:
    """Faded rows of little retention fall dormant, others keep their decayed strength. One projection, no shuffle."""
    eligible = ~F.col("dormant")
    fades = eligible & (decayed(now) < FORGET_FLOOR) & (retention() < RETENTION_FLOOR) & (F.col("importance") < PROTECTED)
    marked = memories.withColumn("forgotten", fades)
    if dry_run:
        return marked
    strength = F.when(eligible & ~F.col("forgotten"), decayed(now)).otherwise(F.col("strength"))
    return marked.withColumn("strength", strength).withColumn("dormant", F.col("dormant") | F.col("forgotten"))


def purge(memories: DataFrame, links: DataFrame, now: float, older_than_days: float | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the named rows, or without dormant rows not touched for that long; incident links go too."""
    if (older_than_days is None) == (ids is None):
        raise ValueError("give ids or older_than_days")
    dead = ids.select("id") if ids is not None else memories.where(F.col("dormant") & (F.col("last_access") < now - older_than_days * 86400)).select("id")
    return delete(memories, links, dead)


def delete(memories: DataFrame, links: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    dead = dead.select(F.col("id").alias("dead")).distinct()
    left = links.join(dead, F.col("src") == F.col("dead"), "left_anti").join(dead, F.col("dst") == F.col("dead"), "left_anti")
    return memories.join(dead, F.col("id") == F.col("dead"), "left_anti"), left


def evict(memories: DataFrame, capacity: int) -> DataFrame:
    """Ids to drop so that `capacity` rows stay: dormant first, then least retention; only unprotected episodes.

    The cut is found by histograms and applied as a filter, so nothing is sorted however many rows go."""
    over = max(0, memories.count() - capacity)
    able = memories.where((F.col("kind") == "episodic") & (F.col("importance") < PROTECTED))
    able = able.select("id", "dormant", retention().alias("retention"), (~F.col("dormant")).cast("int").alias("awake"))
    return least_rows(able, ["awake", "retention", "id"], over).drop("awake")


def touch(memories: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """Each hit adds strength and an access, and sets the last access."""
    n = F.coalesce("hits", F.lit(0))
    out = _hit(memories, hits)
    return out.withColumn("strength", F.col("strength") + TOUCH * n).withColumn("access_count", F.col("access_count") + n).withColumn("last_access", F.when(n > 0, F.lit(now)).otherwise(F.col("last_access"))).drop("hits")


def reinforce(memories: DataFrame, hits: DataFrame) -> DataFrame:
    n = F.coalesce("hits", F.lit(0))
    return _hit(memories, hits).withColumn("strength", F.col("strength") + REINFORCE * n).withColumn("access_count", F.col("access_count") + n).drop("hits")


def _hit(memories: DataFrame, hits: DataFrame) -> DataFrame:
    counts = hits.groupBy(F.col("id").alias("hit_id")).agg(F.count("*").alias("hits"))
    return memories.join(counts, F.col("id") == F.col("hit_id"), "left").drop("hit_id")


def mark(memories: DataFrame, ids: DataFrame, flag: str, value: bool = True, now: float | None = None) -> DataFrame:
    """Set a life-cycle flag; superseding caps strength and confidence, waking sets the last access."""
    named = ids.select(F.col("id").alias("named")).distinct()
    out = memories.join(named, F.col("id") == F.col("named"), "left")
    hit = F.col("named").isNotNull()
    out = out.withColumn(flag, F.when(hit, F.lit(value)).otherwise(F.col(flag)))
    if flag == "superseded" and value:
        for c in ("strength", "confidence"):
            out = out.withColumn(c, F.when(hit, F.least(F.col(c), F.lit(SUPERSEDED_CAP))).otherwise(F.col(c)))
    if flag == "dormant" and not value and now is not None:
        out = out.withColumn("last_access", F.when(hit, F.lit(now)).otherwise(F.col("last_access")))
    return out.drop("named")


def reclassify(memories: DataFrame, links: DataFrame, ids: DataFrame, own: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Move own rows to another name space; links with both ends moved follow, crossing ones are cut."""
    if not target.strip():
        raise ValueError("empty name space")
    moved = memories.where(F.col("namespace") == own).join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("m")).distinct()
    rows = memories.join(moved, F.col("id") == F.col("m"), "left").withColumn("namespace", F.when(F.col("m").isNotNull(), F.lit(target)).otherwise(F.col("namespace"))).drop("m")
    a, b = moved.withColumnRenamed("m", "ma"), moved.withColumnRenamed("m", "mb")
    ends = links.join(a, F.col("src") == F.col("ma"), "left").join(b, F.col("dst") == F.col("mb"), "left")
    both, none = F.col("ma").isNotNull() & F.col("mb").isNotNull(), F.col("ma").isNull() & F.col("mb").isNull()
    ends = ends.where(both | none).withColumn("namespace", F.when(both, F.lit(target)).otherwise(F.col("namespace")))
    return rows, ends.drop("ma", "mb")


def append(table: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Rows with new ids behind the greatest one, numbered in a given order by range partition, not in one task."""
    top = table.agg(F.max("id")).first()[0] or 0
    spark = table.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    placed = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(F.broadcast(before.drop("n")), "_p")  # a row for each partition
    return table.unionByName(out.withColumn("id", F.lit(top) + 1 + F.col("before") + F.col("_i") - F.col("first")).drop("_p", "_i", "before", "first"), allowMissingColumns=True)


def stats(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Counts by life-cycle state, and how many rows the k-nearest graph covers."""
    knn = links.where("type = 'knn'")
    ends = knn.select(F.col("src").alias("e")).union(knn.select("dst")).distinct().agg(F.count("*").alias("covered"))
    yes = lambda c: F.count_if(c)
    own = memories.agg(
        F.count("*").alias("total"), yes(~F.col("consolidated") & ~F.col("dormant") & ~F.col("superseded")).alias("active"), yes(F.col("dormant")).alias("dormant"),
        yes(F.col("superseded")).alias("superseded"), yes(F.col("consolidated")).alias("consolidated"), yes(F.col("kind") == "semantic").alias("semantic"),
    )
    return own.crossJoin(ends)  # one row each


def by_namespace(memories: DataFrame) -> DataFrame:
    return memories.groupBy("namespace").agg(F.count("*").alias("n"), F.count_if("dormant").alias("dormant"), F.round(F.avg("strength"), 6).alias("mean_strength"))


def state() -> Column:
    """What a viewer shows a row as."""
    return (
        F.when(F.col("dormant"), "dormant").when(F.col("superseded"), "superseded").when(F.col("is_atom"), "atom").when(F.col("kind") == "semantic", "semantic").otherwise("episodic")
    )


def soon_dormant(now: float) -> Column:
    return (F.col("strength") < 0.4) & (F.lit(now) - F.col("last_access") > 7 * 86400) & (F.col("importance") < PROTECTED)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key-value rows with changes laid over them."""
    new = changes.select(*keys, F.col(value).alias("_new"))
    return table.join(new, keys, "full").select(*keys, F.coalesce("_new", value).alias(value))


def shadowed(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Ids of facts whose text row (the memory that names the fact) sleeps or was superseded."""
    gone = memories.where("(dormant or superseded) and fact_id is not null").select(F.col("fact_id").alias("shadow"))
    return facts.join(gone, F.col("id") == F.col("shadow"), "left_semi").select("id")


def record(hits: DataFrame, memories: DataFrame, own: str) -> DataFrame:
    """What recall hands out: text, utility, the project it comes from if foreign, and whether the text tries to steer a model."""
    from engramma.functions.text import suspicious

    both = hits.join(memories.select("id", "text", "kind", "namespace", "access_count"), "id")
    return both.select("*", utility().alias("utility"), F.when(F.col("namespace") != own, F.col("namespace")).alias("project"), suspicious(F.col("text")).alias("untrusted"))


def timeline(memories: DataFrame) -> DataFrame:
    """Rows by day of writing (UTC) and kind."""
    day = F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd")
    return memories.groupBy(day.alias("day"), "kind").agg(F.count("*").alias("n"), F.count_if("dormant").alias("dormant"))


def scatter(memories: DataFrame, step: float = 0.1) -> DataFrame:
    """Rows by importance and confidence, in squares of `step`."""
    cell = lambda c: F.round(F.floor(F.col(c) * F.lit(1 / step)) / F.lit(1 / step), 9).alias(c)
    return memories.groupBy(cell("importance"), cell("confidence")).agg(F.count("*").alias("n"))
