"""How the driver's tables stand for a memory store, in Spark and in SQL: both sides derive the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_740_000_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("lang").alias("namespace"), F.when(d % 7 == 0, "semantic").otherwise("episodic").alias("kind"), "text",
        (d % 97 / 97.0).alias("novelty"), (d * 37 % 101 / 100.0).alias("importance"), (d * 53 % 101 / 100.0).alias("confidence"),
        (d * 13 % 300 / 100.0).alias("strength"), (d % 9).alias("access_count"), (F.lit(1_700_000_000.0) + d * 3600).alias("created"),
        (F.lit(NOW) - d * 7919 % 9_000_000).alias("last_access"), (d % 11 == 0).alias("consolidated"), (d % 13 == 0).alias("superseded"), (d % 5 == 0).alias("dormant"),
        F.when(d % 4 == 1, d * 7 % 1000).alias("fact_id"),
    )


MEM = """mem as (select doc_id id, lang namespace, case when doc_id % 7 = 0 then 'semantic' else 'episodic' end kind, text,
  (doc_id % 97)::double / 97 novelty, (doc_id * 37 % 101)::double / 100 importance, (doc_id * 53 % 101)::double / 100 confidence,
  (doc_id * 13 % 300)::double / 100 strength, doc_id % 9 access_count, 1700000000::double + doc_id * 3600 created,
  1740000000::double - doc_id * 7919 % 9000000 last_access, doc_id % 11 = 0 consolidated, doc_id % 13 = 0 superseded, doc_id % 5 = 0 dormant,
  case when doc_id % 4 = 1 then doc_id * 7 % 1000 end fact_id from documents)"""
RETENTION = "(0.4::double * importance + 0.3::double * confidence + 0.3::double * (least(access_count, 5)::double / 5))"
DECAYED = "(strength * pow(0.5::double, (1740000000::double - last_access) / case when kind = 'semantic' then 6048000::double else 1209600::double end))"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together twice or more, as a typed graph."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("src")), li.select("l_orderkey", F.col("l_partkey").alias("dst"))
    pairs = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n")).where("n >= 2")
    kind = F.element_at(F.array(*map(F.lit, ("lexical", "dream", "knn", "update"))), ((F.col("src") + F.col("dst")) % 4 + 1).cast("int"))
    status = F.when(kind == "dream", F.element_at(F.array(*map(F.lit, ("proposed", "confirmed", "rejected"))), (F.col("src") % 3 + 1).cast("int"))).otherwise("confirmed")
    return pairs.select("src", "dst", F.least(F.lit(1.0), 0.4 + 0.1 * F.col("n") + F.col("src") % 7 / 100.0).alias("weight"), kind.alias("type"), status.alias("status"))


LNK = """li as (select distinct l_orderkey, l_partkey from lineitem),
  lnk as (select src, dst, least(1::double, 0.4::double + 0.1::double * n + (src % 7)::double / 100) weight,
    (['lexical', 'dream', 'knn', 'update'])[(src + dst) % 4 + 1] "type",
    case when (src + dst) % 4 = 1 then (['proposed', 'confirmed', 'rejected'])[src % 3 + 1] else 'confirmed' end status
    from (select a.l_partkey src, b.l_partkey dst, count(*) n from li a join li b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2) where n >= 2)"""
NEI = """nei as (select node, other, max(weight) weight from (select src node, dst other, weight from lnk where status = 'confirmed' and src <> dst
    union all select dst, src, weight from lnk where status = 'confirmed' and src <> dst) group by 1, 2)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes with memory attributes."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("id"), F.col("p_brand").alias("namespace"), (p * 53 % 101 / 100.0).alias("confidence"), (p * 13 % 300 / 100.0).alias("strength"), (p % 5 == 0).alias("dormant"), (p % 13 == 0).alias("superseded")
    )


PRT = """prt as (select p_partkey id, p_brand namespace, (p_partkey * 53 % 101)::double / 100 confidence, (p_partkey * 13 % 300)::double / 100 strength,
    p_partkey % 5 = 0 dormant, p_partkey % 13 = 0 superseded from part)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did last, as facts."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject"), F.lit("last_event").alias("predicate"), F.col("event_type").alias("object"), F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"))


FCT = "fct as (select event_id id, 'user' || user_id subject, 'last_event' predicate, event_type \"object\", epoch_us(ts) valid_from from events)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of a decision log."""
    e = read(spark, sf_dir, "events")
    n = F.floor("value").cast("long")
    action = F.when(F.col("event_type") == "click", "tokens").otherwise(F.col("event_type"))
    cut = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" (de "), (n * 2).cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.rpad(action, 9, " "), F.lit(" "), n.cast("string"), F.lit(" tok"), cut)
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"), line.alias("value"))


LOG = """lg as (select event_id line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || rpad(case when event_type = 'click' then 'tokens' else event_type end, 9, ' ') || ' '
    || floor(value)::bigint || ' tok' || case when event_id % 3 = 0 then ' (de ' || (floor(value)::bigint * 2) || ')' else '' end line from events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "conv_id", "turn", "role", "text")
