import random

from pyspark.sql import functions as F

from engramma.functions import text as tx
from engramma.operators import lifecycle, order, surprise


def test_kth_and_least_rows(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 1e-9, 5.0, rng.random(), rng.random() * 1e6, -3.0]) for _ in range(700)]
    df = spark.createDataFrame([(i, v, int(v > 4)) for i, v in enumerate(values)], "id long, v double, a int").repartition(5)
    for k in (0, 1, 350, 698, 699):
        assert order.kth(df, "v", k) == sorted(values)[k]
    assert order.kth(df.limit(0), "v", 0) is None
    want = sorted((a, v, i) for i, v, a in ((i, v, int(v > 4)) for i, v in enumerate(values)))
    for n in (0, 1, 20, 500, 699, 700, 900):
        got = sorted(r.id for r in order.least_rows(df, ["a", "v", "id"], n).collect())
        assert got == sorted(i for _, _, i in want[:n])
    ranks = {r.a: r.v for r in order.nearest_ranks(df, ["a"], "v", 0.95).collect()}
    for a in (0, 1):
        own = sorted(v for _, v, x in ((i, v, int(v > 4)) for i, v in enumerate(values)) if x == a)
        assert ranks[a] == own[min(len(own) - 1, int(0.95 * len(own)))]


def test_evict_takes_dormant_and_least_kept_first(spark):
    rng = random.Random(4)
    items = [(i, "episodic" if rng.random() < 0.8 else "semantic", rng.choice([0.1, 0.3, 0.9]), rng.choice([0.2, 0.5]), rng.randrange(7), rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(items, "id long, kind string, importance double, confidence double, access_count long, dormant boolean")
    keep = lambda x: 0.4 * x[2] + 0.3 * x[3] + 0.3 * min(x[4], 5) / 5
    able = sorted((not x[5], round(keep(x), 12), x[0]) for x in items if x[1] == "episodic" and x[2] < 0.8)
    for capacity in (500, 190, 120, 3):
        got = sorted((not r.dormant, round(r.retention, 12), r.id) for r in lifecycle.evict(df, capacity).collect())
        assert got == able[: max(0, 200 - capacity)]


def plain_surprise(observations, counts=None, history=()):
    """One after another: a single name space."""
    from math import log2

    uni, two, ctx, total, scores, out = {}, {}, {}, 0, list(history), []
    for (c, t), n in (counts or {}).items():
        if c == "":
            uni[t] = uni.get(t, 0) + n
            total += n
        else:
            two[c, t] = two.get((c, t), 0) + n
            ctx[c] = ctx.get(c, 0) + n
    for seq, tokens in observations:
        bits = []
        for prev, t in zip([None, *tokens], tokens, strict=False):
            p = (uni.get(t, 0) + 0.01) / (total + 500)
            if prev is not None and ctx.get(prev, 0) > 0:
                p = 0.6 * (two.get((prev, t), 0) + 0.01) / (ctx[prev] + 500) + 0.4 * p
            bits.append(-log2(p))
        s = min(1.0, sum(bits) / len(bits) / log2(50_000)) if bits else 0.0
        last = sorted(scores[-300:])
        if len(last) < 40:
            flag = s < 0.05
        else:
            at = 0.2 * (len(last) - 1)
            low = last[int(at)] + (at - int(at)) * (last[min(int(at) + 1, len(last) - 1)] - last[int(at)])
            flag = s <= low + 1e-12
        out.append((seq, round(s, 8), flag))
        scores.append(s)
        total += len(tokens)
        for prev, t in zip([None, *tokens], tokens, strict=False):
            uni[t] = uni.get(t, 0) + 1
            if prev is not None:
                two[prev, t] = two.get((prev, t), 0) + 1
                ctx[prev] = ctx.get(prev, 0) + 1
    return out, scores


def test_surprise_in_spans_equals_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(30)]
    obs = [(i * 3 + 1, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(420)]
    want, scores = plain_surprise([(s, t.split()) for s, t in obs])
    monkeypatch.setattr(surprise, "SPAN", 310)
    df = spark.createDataFrame([("n", s, t) for s, t in obs], "namespace string, seq long, text string")
    df = df.select("namespace", "seq", F.filter(tx.tokens(F.col("text")), lambda x: x != "").alias("tokens"))
    short = lambda d: sorted((r.seq, round(r.surprise, 8), r.predictable) for r in d.collect())
    close = lambda a, b: len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-7 and x[2] == y[2] for x, y in zip(a, b, strict=True))
    assert close(short(surprise.surprise(df)), want)
    early, late = df.where("seq < 700"), df.where("seq >= 700")
    counts = surprise.merged_counts(spark.createDataFrame([], "namespace string, context string, token string, count long"), early)
    history = surprise.merged_history(spark.createDataFrame([], "id long, namespace string, score double"), surprise.surprise(early))
    assert history.count() == min(300, early.count())
    assert close(short(surprise.surprise(late, counts, history)), [x for x in want if x[0] >= 700])
    more = surprise.merged_history(history, surprise.surprise(late, counts, history))
    assert [round(r.score, 8) for r in more.orderBy("id").collect()] == [round(x, 8) for x in scores[-300:]]


def test_values_carried_along_ranges(spark):
    """A hot key over several ranges, with ties, nulls and keys that start and end inside a range."""
    rng = random.Random(9)
    data = [("hot", rng.choice([None, *range(300)]), i, rng.choice([None, None, f"v{i}"])) for i in range(900)] + [(f"k{i % 40}", i, i, rng.choice([None, f"w{i}"])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, id int, v string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = order.Ranged(df, ["k"], ["t", "id"])
        got = ranged.with_last("upto", F.col("v")).with_last("before", F.col("v"), inclusive=False).with_next("after", F.col("v"))
        assert got.rows.where("k = 'hot'").select("_range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for key in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        for i, d in enumerate(own):
            last = lambda rows: next((x[3] for x in reversed(rows) if x[3] is not None), None)
            want.append((*d, last(own[: i + 1]), last(own[:i]), next((x[3] for x in own[i + 1 :] if x[3] is not None), None)))
    assert sorted(map(tuple, got.done().collect()), key=str) == sorted(want, key=str)
