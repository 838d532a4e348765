"""The typed link graph: fold of arrivals, neighbours, spreading, creative recall, open wedges, search structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions.text import creative_fit
from engramma.operators.order import kth
from engramma.sources.snapshots import checkpointed

#: Fixed values of the graph.
RANKS = {"knn": 0, "proposed": 1, "dream": 2, "rejected": 3, "observed": 4}
GROWTH, LINK_SIM, MIN_GAIN, DORMANT_FLOOR = 0.3, 0.58, 0.05, 0.12
SETTLED = 128  # steps of growth: what is missing shrinks to 0.7 of it, and 0.7^104 is below half of a double's last bit


def rank(kind: Column, status: Column) -> Column:
    """What may replace what: nearest < proposed < confirmed dream < rejected < observed."""
    return F.when(kind == "knn", 0).when(status == "rejected", 3).when(kind == "dream", F.when(status == "proposed", 1).otherwise(2)).otherwise(4)


def fold_links(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One link for each (src, dst) from arrivals (seq, src, dst, weight, type, status), in order of seq, and before them the stored links.

    The first arrival of the greatest rank settles type, status and the weight to start from; each one after it only lets the weight grow by
    a share of what is missing (a rejected link's stays), so a count is all that is needed of them, however many there are. The steps are taken one by one, as a
    closed form differs from them in the last bits; behind SETTLED of them a double between 0 and 1 changes no more."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight").cast("double")))
    cols = ["src", "dst", F.col("seq").cast("long").alias("seq"), weight.alias("weight"), "type", "status"]
    all_ = arrivals.select(*cols)
    if stored is not None:
        all_ = all_.unionByName(stored.withColumn("seq", F.lit(-(1 << 62))).select(*cols))
    all_ = all_.where("src <> dst")
    first = F.max(F.struct(rank(F.col("type"), F.col("status")).alias("rank"), (-F.col("seq")).alias("minus"), "weight", "type", "status"))
    settled = all_.groupBy("src", "dst").agg(first.alias("l"))
    later = all_.select("src", "dst", "seq").join(settled.select("src", "dst", (-F.col("l.minus")).alias("at")), ["src", "dst"]).where("seq > at").groupBy("src", "dst").agg(F.count("*").alias("n"))
    steps = F.array_repeat(F.lit(0), F.least(F.coalesce("n", F.lit(0)), F.lit(SETTLED)).cast("int"))
    grown = F.aggregate(steps, F.col("l.weight"), lambda w, _: w + GROWTH * (1 - w))
    kept = F.when(F.col("l.status") == "rejected", F.col("l.weight")).otherwise(grown)
    return settled.join(later, ["src", "dst"], "left").select("src", "dst", kept.alias("weight"), "l.type", "l.status")


def set_status(links: DataFrame, pairs: DataFrame, status: str) -> DataFrame:
    """Confirm or reject proposed dreams, named in either direction."""
    if status not in ("confirmed", "rejected"):
        raise ValueError(status)
    named = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")).distinct()
    out = links.join(named, (F.col("src") == F.col("x")) & (F.col("dst") == F.col("y")), "left")
    hit = F.col("x").isNotNull() & (F.col("type") == "dream") & (F.col("status") == "proposed")
    return out.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).drop("x", "y")


def neighbours(links: DataFrame, include_proposed: bool = False) -> DataFrame:
    """(node, other, weight): both directions, confirmed only, the greatest weight of a pair."""
    good = links.where(F.col("status").isin("confirmed", "proposed") if include_proposed else F.col("status") == "confirmed").where("src <> dst")
    both = good.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(good.select("dst", "src", "weight"))
    return both.groupBy("node", "other").agg(F.max("weight").alias("weight"))


def shown_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are shown."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return links.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def spread(activation: DataFrame, edges: DataFrame, seeds: int, hops: int, factor: float = 0.5) -> DataFrame:
    """Spreading activation in synchronous rounds over (query_id, id, act): adds `spread`, the final value, and `parent`.

    The frontier of a round is what the round before raised; edges join on the node only,
    so the work follows the frontier.  Rounds are few (at most five), and each one's
    state is written, not recomputed.
    """
    top = Window.partitionBy("query_id").orderBy(F.desc("act"), "id")
    state = activation.withColumn("spread", F.col("act")).withColumn("parent", F.lit(None).cast("long"))
    frontier = activation.withColumn("r", F.row_number().over(top)).where(F.col("r") <= seeds).select("query_id", F.col("id").alias("node"), F.col("act").alias("value"))
    for _ in range(hops):
        sent = frontier.join(edges, "node").select("query_id", F.col("other").alias("id"), (F.col("value") * F.col("weight") * factor).alias("got"), "node")
        best = sent.groupBy("query_id", "id").agg(F.max(F.struct("got", (-F.col("node")).alias("minus"))).alias("b")).select("query_id", "id", "b.got", (-F.col("b.minus")).alias("from"))
        joined = state.join(best, ["query_id", "id"], "left")
        up = F.coalesce(F.col("got") > F.col("spread"), F.lit(False))
        state = checkpointed(joined.select(
            "query_id", "id", "act", F.when(up, F.col("got")).otherwise(F.col("spread")).alias("spread"),
            F.when(up, F.col("from")).otherwise(F.col("parent")).alias("parent"), up.alias("raised"),
        ))
        frontier = state.where("raised").select("query_id", F.col("id").alias("node"), F.col("spread").alias("value"))
        state = state.drop("raised")
    return state


def muse(activation: DataFrame, edges: DataFrame, k: int = 3, hops: int = 3) -> DataFrame:
    """Creative recall over (query_id, id, act, dormant): what association raises beyond likeness, and sleeping rows that fit."""
    final = spread(activation.select("query_id", "id", "act"), edges, k, max(1, hops), 0.6)
    rows = final.join(activation.select("query_id", "id", "dormant"), ["query_id", "id"])
    gain = F.greatest(F.lit(0.0), F.col("spread") - F.col("act"))
    score = F.when(gain >= MIN_GAIN, gain * F.when(F.col("dormant"), 1.6).otherwise(1.0)).when(F.col("dormant") & (F.col("act") >= DORMANT_FLOOR), F.col("act") * 0.5)
    via = F.when(gain >= MIN_GAIN, "association").otherwise("dormant")
    rows = rows.withColumn("score", score).withColumn("gain", gain).withColumn("via", via).where("score is not null")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).withColumn("wakes", F.col("dormant") & (F.col("gain") >= MIN_GAIN))


def dream(nodes: DataFrame, edges: DataFrame, similarity, bridges: int = 5) -> DataFrame:
    """Hypotheses between nodes (id, confidence, dormant) with a common neighbour but no link.

    `similarity(a, b)` is a column expression over the joined ends, aliased `a` and `b`.
    Wedges through a hub grow with the square of its degree, as the operator asks for.
    """
    ends = edges.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    e1, e2 = ends.select(F.col("node").alias("via"), F.col("other").alias("a_id"), F.col("weight").alias("wa")), ends.select(F.col("node").alias("via"), F.col("other").alias("b_id"), F.col("weight").alias("wb"))
    wedges = e1.join(e2, "via").where("a_id < b_id")
    pairs = wedges.groupBy("a_id", "b_id").agg(F.min(F.struct("via", F.least("wa", "wb").alias("path"))).alias("w")).select("a_id", "b_id", "w.via", "w.path")
    linked = ends.select(F.col("node").alias("a_id"), F.col("other").alias("b_id"))
    open_ = pairs.join(linked, ["a_id", "b_id"], "left_anti")
    a, b = nodes.alias("a"), nodes.alias("b")
    cand = open_.join(a, F.col("a_id") == F.col("a.id")).join(b, F.col("b_id") == F.col("b.id"))
    cand = checkpointed(cand.select(
        "a_id", "b_id", "via", "path", similarity("a", "b").alias("sim"), ((F.col("a.confidence") + F.col("b.confidence")) / 2).alias("conf"), (F.col("a.dormant") | F.col("b.dormant")).alias("latent"),
    ))
    n = cand.count()
    local = ideal = 0.0
    if n >= 5:
        local = kth(cand, "sim", n // 2)
    gaps = cand.where((F.col("path") >= LINK_SIM) & (F.col("path") > F.col("sim"))).select((F.col("path") - F.col("sim")).alias("gap"))
    if (m := gaps.count()) > 0:
        ideal = kth(gaps, "gap", max(0, int(m * 0.9) - 1))
    tent = creative_fit(F.col("sim"))
    calibrate = F.lit(local > 0.72 and ideal > 0) & (tent <= 0) & (F.col("path") > F.col("sim"))
    fit = F.when(calibrate, F.least(F.lit(1.0), (F.col("path") - F.col("sim")) / F.lit(ideal or 1.0))).otherwise(tent)
    score = F.col("fit") * (0.5 + F.col("path")) * (0.5 + F.col("conf")) * F.when(F.col("latent"), 1.15).otherwise(1.0)
    scored = cand.withColumn("fit", fit).withColumn("calibration", F.when(calibrate, "local").otherwise("absolute")).where("fit > 0").withColumn("score", score)
    return scored.orderBy(F.desc(F.round("score", 9)), "a_id", "b_id").limit(bridges)


def dream_all(nodes: DataFrame, edges: DataFrame, similarity, bridges: int = 5) -> DataFrame:
    """Bridges of every name space of the nodes (each calibrated by itself), the most alike first. One dream a name space: there are few."""
    spaces = [r["namespace"] for r in nodes.select("namespace").distinct().orderBy("namespace").collect()]
    out = None
    for space in spaces:
        own = nodes.where(F.col("namespace").eqNullSafe(F.lit(space)))
        one = dream(own.drop("namespace"), edges, similarity, bridges).withColumn("namespace", F.lit(space).cast("string"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc(F.round("sim", 9)), "namespace", "a_id", "b_id") if out is not None else None


def capped(links: DataFrame, most: int = 40) -> DataFrame:
    """Nearest links (src, dst, weight) with at most `most` a node: a link stays if it is among the strongest of both its ends."""
    both = links.select("src", "dst", "weight", F.col("src").alias("node")).union(links.select("src", "dst", "weight", F.col("dst").alias("node")))
    best = Window.partitionBy("node").orderBy(F.desc("weight"), "src", "dst")
    kept = both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    return kept.groupBy("src", "dst", "weight").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def coverage(edges: DataFrame, samples: int = 8) -> DataFrame:
    """One row: nodes, components, mean degree, mean share of nodes within two steps of sample nodes (spread over the ids by hash), and whether shortcuts are needed."""
    degree = degrees(edges)
    heads = components(edges).select("root").distinct().agg(F.count("*").alias("components"))
    one = degree.agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean_degree")).crossJoin(heads)  # one row each
    start = degree.select("node").orderBy(F.md5(F.col("node").cast("string").cast("binary")), "node").limit(samples).select(F.col("node").alias("start"))
    near = start.join(edges.select(F.col("node").alias("start"), F.col("other").alias("mid")), "start")
    far = near.join(edges.select(F.col("node").alias("mid"), F.col("other").alias("end")), "mid").select("start", "end")
    reach = near.select("start", F.col("mid").alias("end")).union(far).union(start.select("start", F.col("start").alias("end"))).distinct().groupBy("start").agg(F.count("*").alias("c"))
    two = reach.agg(F.avg("c").alias("c"))
    share = F.when(F.col("nodes") > 0, F.col("c") / F.col("nodes")).otherwise(0.0)
    dense = (F.col("components") == 1) & (F.col("mean_degree") >= 8) & (share >= 0.30)
    return one.crossJoin(two).select("nodes", "components", F.round("mean_degree", 9).alias("mean_degree"), F.round(share, 9).alias("two_hops"), (~dense).alias("shortcuts"))


def with_shortcuts(edges: DataFrame, per_node: int = 2, seed: int = 0) -> DataFrame:
    """`edges` and, where `coverage` asks for them, links of every node to `per_node` others drawn by hash, both ways, of no weight."""
    if not coverage(edges).first()["shortcuts"]:
        return edges
    nodes = degrees(edges).select("node")
    n = nodes.count()
    placed = nodes.repartitionByRange("node").sortWithinPartitions("node")  # numbered by range and place in it
    placed = checkpointed(placed.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(n)).alias("slot")))
    pick = placed.select("node", F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(seed + 1 + i)), F.lit(n)) for i in range(per_node)])).alias("slot"))
    drawn = pick.join(placed.select("slot", F.col("node").alias("other")), "slot").where("node <> other").select("node", "other")
    both = drawn.union(drawn.select("other", "node")).distinct().join(edges.select("node", "other"), ["node", "other"], "left_anti")
    return edges.select("node", "other", "weight").unionByName(both.withColumn("weight", F.lit(0.0)))


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): everything reachable in so many steps, with its distance."""
    seen = start.select("node", F.lit(0).alias("hop"))
    frontier = seen.select("node")
    for hop in range(1, hops + 1):
        reached = frontier.join(edges, "node").select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = checkpointed(reached.withColumn("hop", F.lit(hop)))
        seen, frontier = seen.union(new), new.select("node")
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.count("*").alias("degree"))


def hub(edges: DataFrame) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(1)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, others, weights, degree, bytes): a row for each node, its neighbours in order; bytes are those of its ids and of the row's two offsets."""
    rows = edges.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("other", "weight"))).alias("l"))
    n = F.size("l").cast("long")
    return rows.select("node", F.col("l.other").alias("others"), F.col("l.weight").alias("weights"), n.alias("degree"), (16 + 8 * n).alias("bytes"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) by least label with jumps; rounds grow with the logarithm of the longest path."""
    labels = checkpointed(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("m"))
        named = checkpointed(labels.join(heard, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root")))
        up = named.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = checkpointed(named.join(up, named.root == up.r, "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        if not new.where("root <> old").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def landmarks(edges: DataFrame) -> DataFrame:
    """Entry points of navigable search: the node of greatest degree in each component."""
    both = components(edges).join(degrees(edges), "node")
    return both.groupBy("root").agg(F.max(F.struct("degree", (-F.col("node")).alias("m"))).alias("b")).select("root", (-F.col("b.m")).alias("landmark"), "b.degree")


def nearest_links(pairs: DataFrame, existing: DataFrame, m: int = 12) -> DataFrame:
    """New knn links from similar pairs (id, other, sim): each row's `m` nearest, sorted ends, only if not yet linked."""
    top = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    near = pairs.where("id <> other").withColumn("r", F.row_number().over(top)).where(F.col("r") <= m)
    new = near.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), "sim").groupBy("src", "dst").agg(F.max("sim").alias("weight"))
    return new.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def navigation(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Whether recall may navigate: size, coverage and density of the k-nearest graph."""
    own = memories.where("not superseded").select("id")
    knn = links.where("type = 'knn'")
    inside = shown_edges(knn, own)
    covered = inside.select(F.col("src").alias("e")).union(inside.select("dst")).distinct()
    row = own.agg(F.count("*").alias("n")).crossJoin(inside.agg(F.count("*").alias("e"))).crossJoin(covered.agg(F.count("*").alias("c")))
    cover = F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0)
    density = F.when(F.col("n") > 1, 2 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return row.select("n", F.round(cover, 9).alias("coverage"), F.round(density, 9).alias("density"), ((F.col("n") >= 32) & (cover >= 0.60) & (density < 0.75)).alias("navigate"))
