"""Facts with valid time: closing what a new fact contradicts, and questions as of a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.operators.order import Ranged

ROLES = ("subject", "predicate", "object", "time", "source")
MATCH, ANSWER, MARGIN = 0.56, 0.56, 0.06


def close_runs(arrivals: DataFrame) -> DataFrame:
    """Valid-time rows of (id, subject, predicate, object, valid_from): a fact holds until the next one
    of its subject and predicate with another object starts, so equal neighbours close together. A subject's history goes in ranges of time, however long.

    `supersedes` is the first of the facts that a new one closes (all are closed); null if it closes none."""
    whole = arrivals.where("subject is not null and predicate is not null and object is not null")
    rows = Ranged(whole, ["subject", "predicate"], ["valid_from", "id"]).with_last("_past", F.col("object"), inclusive=False)
    head = F.when(F.col("_past").isNull() | (F.col("_past") != F.col("object")), F.struct("id", "valid_from"))
    rows = rows.with_next("_next", head).with_last("_before", head, inclusive=False)
    starts = F.col("_past").isNull() | (F.col("_past") != F.col("object"))
    closed = rows.done().withColumn("valid_to", F.col("_next.valid_from")).withColumn("supersedes", F.when(starts, F.col("_before.id"))).drop("_past", "_next", "_before")
    kinds = dict(arrivals.dtypes)
    open_ = arrivals.where("subject is null or predicate is null or object is null")
    open_ = open_.withColumn("valid_to", F.lit(None).cast(kinds["valid_from"])).withColumn("supersedes", F.lit(None).cast(kinds["id"]))
    return closed.unionByName(open_)


def clean_fields(fields: DataFrame) -> DataFrame:
    """Rows whose roles are trimmed (empty: null) and of which at least two are there."""
    trimmed = lambda r: F.nullif(F.btrim(F.col(r).cast("string"), F.lit(" \t\n\r\x0b\x0c")), F.lit(""))
    given = [r for r in ROLES if r in fields.columns]
    out = fields.select(*[c for c in fields.columns if c not in ROLES], *[trimmed(r).alias(r) if r in given else F.lit(None).cast("string").alias(r) for r in ROLES])
    return out.where(sum(F.col(r).isNotNull().cast("int") for r in ROLES) >= 2)


def remember(stored: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored facts and new ones (id, valid_from, roles) as one table, and the text rows that shadow the new ones.

    New facts need two fields. What a new fact contradicts among facts that still hold is closed when it starts, and stays as history;
    facts closed before are not touched. Shadows (fact_id, text, novelty, importance, confidence) go to the memories with their vectors."""
    new = clean_fields(arrivals)
    cols = ["id", "valid_from", *ROLES]
    lacking = [F.lit(None).cast("string").alias(r) for r in ROLES if r not in stored.columns]
    old = stored.select("*", *lacking)
    open_ = old.where("valid_to is null")
    kept = open_.select("id", F.col("supersedes").alias("was")) if "supersedes" in open_.columns else open_.select("id", F.lit(None).cast("long").alias("was"))
    run = close_runs(open_.select(*cols).unionByName(new.select(*cols))).join(kept, "id", "left").withColumn("supersedes", F.coalesce("was", "supersedes")).drop("was")
    done = old.where("valid_to is not null")
    done = done if "supersedes" in done.columns else done.withColumn("supersedes", F.lit(None).cast("long"))
    shadow = new.select(F.col("id").alias("fact_id"), F.concat_ws(" ", *ROLES).alias("text"), F.lit(1.0).alias("novelty"), F.lit(0.6).alias("importance"), F.lit(0.6).alias("confidence"))
    return done.select(run.columns).unionByName(run), shadow


def close(facts: DataFrame, ids: DataFrame, when) -> DataFrame:
    """Facts with the named ones closed at a time, if they still hold."""
    named = ids.select(F.col("id").alias("named")).distinct()
    out = facts.join(named, F.col("id") == F.col("named"), "left")
    ends = F.when(F.col("named").isNotNull() & F.col("valid_to").isNull(), F.lit(when)).otherwise(F.col("valid_to"))
    return out.withColumn("valid_to", ends).drop("named")


def as_of(facts: DataFrame, at=None) -> DataFrame:
    """Facts that hold at a time (a value or a column), or now."""
    if at is None:
        return facts.where("valid_to is null")
    at = at if hasattr(at, "_jc") or hasattr(at, "_expr") else F.lit(at)
    return facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def ask_exact(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, object) for probes (probe_id, subject, predicate, at): the last fact that started by then, if it still holds.

    Facts and probes go along one order of time, in ranges, so no probe meets its subject's whole history and no task holds one. As `close_runs` leaves
    them, facts of one subject and predicate that hold at a time have one object."""
    none = F.lit(None)
    kinds = dict(facts.dtypes)
    f = facts.where("subject is not null and predicate is not null").select(
        "subject", "predicate", F.col("valid_from").alias("t"), F.lit(0).alias("asked"), "id", none.cast("long").alias("probe_id"), F.struct("object", "valid_to").alias("f")
    )
    p = probes.select(
        "subject", "predicate", F.col("at").alias("t"), F.lit(1).alias("asked"), none.cast(kinds["id"]).alias("id"), F.col("probe_id").cast("long").alias("probe_id"),
        none.cast(f.schema["f"].dataType).alias("f"),
    )
    both = f.unionByName(p).where("subject is not null and predicate is not null").withColumn("nth", F.coalesce("id", "probe_id"))
    asked = Ranged(both, ["subject", "predicate"], ["t", "asked", "nth"]).with_last("l", F.col("f")).done().where("asked = 1")
    lost = probes.where("subject is null or predicate is null").select(F.col("probe_id").cast("long").alias("probe_id"), none.cast("string").alias("object"))
    holds = F.col("l.valid_to").isNull() | (F.col("l.valid_to") > F.col("t"))
    return asked.select("probe_id", F.when(holds, F.col("l.object")).alias("object")).unionByName(lost)


def contradicted(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Current facts that new ones (subject, predicate, object) contradict."""
    n = new.select("subject", "predicate", F.col("object").alias("claimed")).distinct()
    return as_of(facts).join(n, ["subject", "predicate"]).where("object <> claimed")


def encoded(facts: DataFrame) -> DataFrame:
    """Facts with `hv`: the majority of each role bound to its value. To be stored with them."""
    from engramma.functions import hv

    given = [r for r in ROLES if r in facts.columns]

    @F.pandas_udf(T.BinaryType())
    def encode(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([hv.bundle([hv.random_hv(hv.ROLE_SEEDS[r]) ^ hv.encode_text(v) for r, v in zip(given, row, strict=True) if v]).tobytes() for row in rows])

    return facts.withColumn("hv", encode(*given))


def ask_roles(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers by hypervectors to (question_id, role, at, known roles...): (question_id, answer, match, similarity, margin); answer is null where it abstains.

    facts have their stored `hv`. The known roles are matched against the facts that hold (at `at`, or now where that is null), the asked role is
    unbound from the best one, and the result cleaned up among all values. Questions go in blocks of bounded size; tasks send their best fact only."""
    from engramma.functions import hv
    from engramma.operators import recall
    from engramma.sources.snapshots import checkpointed

    if questions.where(~F.col("role").isin(*ROLES) | F.col("role").isNull()).limit(1).count():
        raise ValueError("unknown role")
    known = [r for r in ROLES if r in questions.columns]
    asks = checkpointed(encoded(questions.select("question_id", "role", F.col("at").cast("double").alias("at"), *known)))
    rows = facts.select("id", "hv", F.col("valid_from").cast("double").alias("valid_from"), F.col("valid_to").cast("double").alias("valid_to"))
    found = None
    for block in recall.query_blocks(asks, "question_id"):
        one = _best_fact(rows, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return facts.sparkSession.createDataFrame([], "question_id long, answer string, match double, similarity double, margin double")
    top = found.groupBy("question_id").agg(F.max(F.struct("sim", (-F.col("id")).alias("minus"), "hv")).alias("b")).select("question_id", F.col("b.sim").alias("match"), F.col("b.hv").alias("fact_hv"))

    @F.pandas_udf(T.BinaryType())
    def unbound(vector: pd.Series, role: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(v, np.uint8) ^ hv.random_hv(hv.ROLE_SEEDS[r])).tobytes() for v, r in zip(vector, role, strict=True)])

    sure = top.where(F.col("match") >= MATCH).join(asks.select("question_id", "role"), "question_id")
    noisy = checkpointed(sure.select(F.col("question_id").alias("query_id"), unbound("fact_hv", "role").alias("hv")))
    given = [r for r in ROLES if r in facts.columns]
    values = facts.select(F.explode(F.array_compact(F.array(*given))).alias("value")).distinct()
    values = checkpointed(values.select("value", F.xxhash64("value").alias("id"), hv.encoder()("value").alias("hv")))
    two = recall.closest(values, noisy, 2).join(values.select("id", "value"), "id")
    best = two.groupBy("query_id").agg(F.min(F.struct("rank", "value", "sim")).alias("a"), F.max(F.struct("rank", "sim")).alias("z"))
    margin = F.col("a.sim") - F.when(F.col("z.rank") > 1, F.col("z.sim")).otherwise(0.5)
    best = best.select("query_id", "a.value", F.col("a.sim").alias("similarity"), margin.alias("margin"))
    out = asks.select("question_id").join(top.select("question_id", "match"), "question_id", "left").join(best, F.col("question_id") == F.col("query_id"), "left")
    return out.select("question_id", F.when((F.col("similarity") >= ANSWER) & (F.col("margin") >= MARGIN), F.col("value")).alias("answer"), "match", "similarity", "margin")


def _best_fact(facts: DataFrame, questions: list) -> DataFrame:
    """(question_id, id, sim, hv): each task's best valid fact for each question of a block."""
    from engramma.functions import hv

    at = np.array([np.nan if r["at"] is None else r["at"] for r in questions])
    sent = facts.sparkSession.sparkContext.broadcast(([r["question_id"] for r in questions], at, np.frombuffer(b"".join(bytes(r["hv"]) for r in questions), np.uint8).reshape(len(questions), -1)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, at, q = sent.value
        top: dict[int, tuple] = {}
        for batch in batches:
            m = np.frombuffer(b"".join(batch["hv"]), np.uint8).reshape(len(batch), -1)
            mem, since, until = batch["id"].to_numpy(), batch["valid_from"].to_numpy(float), batch["valid_to"].to_numpy(float)
            for i in range(len(ids)):
                holds = np.isnan(until) if np.isnan(at[i]) else (np.isnan(since) | (since <= at[i])) & (np.isnan(until) | (until > at[i]))
                pick = np.flatnonzero(holds)
                if len(pick):
                    sim = hv.similarity_batch(q[i], m[pick])
                    j = pick[np.lexsort((mem[pick], -sim))[0]]
                    new = (float(sim.max()), -int(mem[j]), batch["hv"].iloc[j])
                    top[i] = max(top[i], new) if i in top else new
        yield pd.DataFrame([(ids[i], -minus, sim, bytes(v)) for i, (sim, minus, v) in top.items()], columns=["question_id", "id", "sim", "hv"])

    return facts.mapInPandas(best, "question_id long, id long, sim double, hv binary")


def ask_role(facts: DataFrame, known: dict[str, str], role: str, at: float | None = None) -> DataFrame:
    """One question: one row of answer (null if it abstains), match, similarity, margin. Facts without `hv` are encoded first."""
    if role not in ROLES:
        raise ValueError(role)
    facts = facts if "hv" in facts.columns else encoded(facts)
    asked = facts.sparkSession.createDataFrame([(0, role, at, *(known.get(r) for r in ROLES))], "question_id long, role string, at double, " + ", ".join(f"{r} string" for r in ROLES))
    return ask_roles(facts, asked).drop("question_id")
