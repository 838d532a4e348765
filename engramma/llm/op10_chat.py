"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker
as the assistant, the others as named users, and system messages unchanged; mask
spans (code points, end exclusive) cover what the assistant of that view says, with
its end mark.  Long conversations are rendered in parts of `turns` turns, to be read
one after another, so that no conversation has to fit one row or one task; spans
count from the part's start.  A turn of more than `turns` messages (null or equal turns
throughout, say) is dealt by hash to pieces of about `turns` messages, rendered one after another.
DataFrame functions only.

Texts are shuffled once: a part's distinct messages are gathered by one aggregation, and views, which
hold no text, are brought to the parts.

Defined cases: rows that are equal in conversation, turn, speaker and text are one
message (delivered twice); messages with the same turn follow speaker, then text;
null turn sorts before turn 0, in the first part; null speaker is `unknown`; null text is
empty; a message without conversation is a conversation of its own; a conversation
with only system messages has no participant, hence no view; marks and line breaks inside names, and
marks inside texts, are broken up, so neither can forge a message; very long texts stay whole; an
empty table gives no rows. Other columns are ignored and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import store

TURNS = 64
SYSTEM = "system"


def bare(c: str, missing: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit(missing)), r"<\|", "< |")


def messages(rows: DataFrame, turns: int) -> DataFrame:
    speaker = F.regexp_replace(bare("role", "unknown"), r"[\n\r]", " ")
    conv = F.col("conv_id").cast("long")
    rows = rows.select(conv.alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), speaker.alias("speaker"), bare("text", "").alias("said"))
    digest = F.md5(F.concat_ws("\x01", "speaker", "said").cast("binary"))
    rows = rows.withColumn("lone", F.when(F.col("conv").isNull(), F.concat(F.col("turn").cast("string"), digest)).otherwise(""))
    rows = rows.withColumn("conv", F.coalesce("conv", F.lit(0)))  # keys without null: `lone` tells
    rows = rows.withColumn("part", F.floor(F.greatest(F.col("turn"), F.lit(0)) / turns))
    return rows.withColumn("spot", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def rotate(conversations: DataFrame, turns: int = TURNS, system: str = SYSTEM) -> DataFrame:
    """One row for each conversation, participant, part and piece: rendered text and mask spans."""
    said = messages(conversations, turns)
    # turns with too many messages, by hashes alone; usually none
    full = said.where("lone = ''").groupBy("conv", "turn").agg(F.count_distinct("spot").alias("c")).where(F.col("c") > turns)
    full = store(full.select(F.col("conv").alias("fc"), F.col("turn").alias("ft"), F.ceil(F.col("c") / turns).alias("pieces")))
    cut = said.join(full, (F.col("conv") == F.col("fc")) & (F.col("turn") == F.col("ft")) & (F.col("lone") == ""), "left")
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.floor(F.col("spot") * F.col("pieces") / (1 << 32)) + 1).cast("long")
    in_turn = F.when(F.col("pieces").isNull(), -1).otherwise(F.col("turn")).cast("long")
    key = ["conv", "lone", "part", "in_turn", "piece"]
    cut = cut.select("conv", "lone", "part", in_turn.alias("in_turn"), piece.alias("piece"), "turn", "speaker", "said")
    parts = cut.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("turn", "speaker", "said"))).alias("dialogue"))
    people = cut.where(F.col("speaker") != system).select("conv", "lone", F.col("speaker").alias("perspective")).distinct()
    views = cut.select(*key).distinct().join(people, ["conv", "lone"])
    both = parts.join(views, key).select(F.when(F.col("lone") == "", F.col("conv")).alias("conv_id"), "perspective", "part", "in_turn", "piece", "dialogue")

    own = lambda m: m["speaker"] == F.col("perspective")
    head = lambda m: F.concat(
        F.lit("<|im_start|>"),
        F.when(m["speaker"] == system, F.lit("system")).when(own(m), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), m["speaker"])),
        F.lit("\n"),
    )
    tail = lambda m: F.concat(m["said"], F.lit("<|im_end|>"))
    shown = F.transform("dialogue", lambda m: F.struct(own(m).alias("own"), head(m).alias("head"), tail(m).alias("tail")))
    rows = both.withColumn("shown", shown)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, m):
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["tail"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(m["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        "conv_id", "perspective", "part", "in_turn", "piece",
        F.size("shown").cast("long").alias("n_messages"),
        F.size(F.filter("shown", lambda m: m["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["tail"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("shown", start, step, lambda acc: acc["spans"]).alias("mask"),
    )


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return got.withColumn("mask", spans)


SQL = r"""
with d as (select distinct conv_id::bigint conv_id, coalesce(turn, -1) turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\n\r]', ' ', 'g') speaker,
          replace(coalesce(text, ''), '<|', '< |') said from conversations),
  h as (select *, ('0x' || substr(md5(speaker || chr(1) || said), 1, 8))::bigint spot from d),
  f as (select conv_id, turn, ceil(count(distinct spot) / 64)::bigint pieces from h group by 1, 2 having count(distinct spot) > 64),
  g as (select h.*, case when pieces is null then -1 else turn end in_turn, case when pieces is null then 0 else spot * pieces // 4294967296 + 1 end piece from h left join f using (conv_id, turn)),
  p as (select distinct conv_id, speaker perspective from d where speaker <> 'system'),
  m as (select g.conv_id, perspective, floor(greatest(turn, 0) / 64)::bigint part, in_turn, piece, turn, speaker, said, speaker = perspective own,
          '<|im_start|>' || case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user name=' || speaker end || chr(10) head,
          said || '<|im_end|>' tail from g join p on g.conv_id = p.conv_id),
  o as (select *, coalesce(sum(length(head) + length(tail) + 1) over (partition by conv_id, perspective, part, in_turn, piece order by turn, speaker, said
          rows between unbounded preceding and 1 preceding), 0)::bigint pos from m)
select conv_id, perspective, part, in_turn::bigint in_turn, piece::bigint piece, count(*)::bigint n_messages, count(*) filter (own)::bigint n_own,
  string_agg(head || tail || chr(10), '' order by turn, speaker, said) rendered,
  coalesce(string_agg((pos + length(head))::varchar || '-' || (pos + length(head) + length(tail))::varchar, ',' order by turn, speaker, said) filter (own), '') mask
from o group by 1, 2, 3, 4, 5
"""
