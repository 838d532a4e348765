"""Dreams over the graph of likeness itself: rows are linked if they are as alike as a least similarity. Its edges grow with the square of the rows
and its wedges with the cube, so neither is made: pairs are looked at tile by tile, and only those that can be among the best leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.functions import hv
from engramma.functions.text import creative_fit
from engramma.operators import recall
from engramma.sources.snapshots import checkpointed

FIRST, LATENT, NEAR = 640, 1.15, 2e-9  # pairs of a tile that tell how good the best are; gain of a sleeping end; scores are compared at nine decimals
VIA_BLOCK, VIA_STEP, CREATIVE = 1 << 14, 1 << 11, (0.55, 0.63, 0.72)  # nodes sent at once, and compared at once; where `creative_fit` begins, peaks and ends


def dream(nodes: DataFrame, least: float, bridges: int = 5, within: str | None = None, bits: int = hv.BITS) -> DataFrame:
    """`graph.dream` of nodes (id, hv, confidence, dormant) whose edges are all pairs as alike as `least`, for each value of `within`: exact.

    What is open is less alike than `least`, so with a `least` of at most 0.72 no median is above that and the fit is never calibrated. A score is bounded by the most alike neighbours of both ends. The k-th best
    of some pairs that are looked at first is a floor; then only pairs whose bound reaches it have their least common neighbour looked for, in blocks of nodes in order of id."""
    if least > CREATIVE[2]:
        raise ValueError(least)
    part = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")) if within else F.lit("")
    rows = checkpointed(nodes.select(F.col("id").cast("long").alias("id"), "hv", F.col("confidence").cast("double").alias("confidence"), "dormant", part.alias("part")))
    near = recall.nearest_pairs(rows, 1, least=least, within="part", bits=bits).select("id", F.col("sim").alias("most"))
    rows = checkpointed(rows.join(near, "id"))  # the others are no ends and between none
    best = Window.partitionBy("part").orderBy(F.desc(F.round("score", 9)), "a_id", "b_id")
    first = _scored(_open_pairs(rows, least, bits, None), rows, least, bits).withColumn("r", F.row_number().over(best)).where(F.col("r") == bridges)
    floors = {r["part"]: r["score"] for r in first.select("part", "score").collect()}  # one a name space: there are few
    got = _scored(_open_pairs(rows, least, bits, floors), rows, least, bits)
    got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= bridges)
    space = F.when(F.col("part").startswith("="), F.expr("substring(part, 2)")).alias("namespace")
    return got.orderBy("part", "r").select("a_id", "b_id", "via", "path", "sim", "conf", "latent", "fit", F.lit("absolute").alias("calibration"), "score", space)


def _open_pairs(rows: DataFrame, least: float, bits: int, floors: dict | None) -> DataFrame:
    """(part, a_id, b_id, sim): pairs that fit and aren't linked, whose score may reach the floor of their part; without floors the most promising of each tile with itself."""
    sims = 1.0 - np.arange(bits + 1) / bits
    low, peak, high = CREATIVE
    fits = np.where(sims <= peak, (sims - low) / (peak - low), (high - sims) / (high - peak))
    fits = np.where((sims < least) & (sims >= low) & (sims <= high) & (fits > 0), fits, 0.0)

    def ends(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, tile, conf, dormant, most = recall.tile_of(frames, "confidence", "dormant", "most")
        dormant, floor = dormant.astype(bool), 0.0 if floors is None else floors.get(key[0], 0.0)
        left, right = (np.flatnonzero(tile == t) for t in key[1:])
        held = None
        if not len(left) or not len(right):
            return
        for low, d in recall.strips(x[left], x[right]):
            mine = left[low : low + len(d)]
            bound = (0.5 + most[mine]) * (0.5 + (conf[mine] + conf[right].max()) / 2) * LATENT
            able = (fits > 0) & (fits >= (floor - _slack(floor)) / bound[:, None])  # one run of differences, as the fit has one peak
            start, end = able.argmax(1), bits - able[:, ::-1].argmax(1)
            end[~able.any(1)] = -1
            i, j = np.nonzero((d >= start[:, None].astype(np.uint16)) & (d.astype(np.int32) <= end[:, None]))
            a, b, fit = mine[i], right[j], d[i, j]
            ok = a < b if key[1] == key[2] else np.ones(len(a), bool)
            a, b, fit = a[ok], b[ok], fit[ok]
            value = fits[fit] * (0.5 + np.minimum(most[a], most[b])) * (0.5 + (conf[a] + conf[b]) / 2) * np.where(dormant[a] | dormant[b], LATENT, 1.0)
            ok = value >= floor - NEAR
            got = pd.DataFrame({"part": key[0], "a_id": np.minimum(ids[a], ids[b]), "b_id": np.maximum(ids[a], ids[b]), "sim": sims[fit], "bound": value})[ok]
            if floors is not None:
                yield got.drop(columns="bound")
            else:
                held = got if held is None else pd.concat([held, got])
                if len(held) > FIRST:
                    held = held.nlargest(FIRST, "bound")
                    floor = float(held["bound"].min())
        if held is not None:
            yield held.drop(columns="bound")

    tiled = recall.in_tiles(rows, "part", bits, "confidence", "dormant", "most")
    tiled = tiled if floors is not None else tiled.where("lo = hi")
    return tiled.groupBy("part", "lo", "hi").applyInPandas(ends, "part string, a_id long, b_id long, sim double")


def _slack(floor: float) -> float:
    """What a bound may lack by rounding."""
    return NEAR + abs(floor) * 1e-12


def _scored(pairs: DataFrame, rows: DataFrame, least: float, bits: int) -> DataFrame:
    """Open pairs with a common neighbour: the least one (`via`), the weaker link to it (`path`), and the score."""
    end = lambda c: rows.select(F.col("id").alias(f"{c}_id"), F.col("hv").alias(f"{c}_hv"), F.col("confidence").alias(f"{c}_c"), F.col("dormant").alias(f"{c}_d"))
    cand = pairs.join(end("a"), "a_id").join(end("b"), "b_id")
    cand = cand.select("part", "a_id", "b_id", "sim", ((F.col("a_c") + F.col("b_c")) / 2).alias("conf"), (F.col("a_d") | F.col("b_d")).alias("latent"), "a_hv", "b_hv")
    left, done = checkpointed(cand), None
    for block in recall.query_blocks(rows.select("id", "part", "hv"), "id", VIA_BLOCK):
        got = checkpointed(_via(left, block, least, bits))
        hit, left = got.where("via is not null").drop("a_hv", "b_hv"), got.where("via is null").drop("via", "path")
        done = hit if done is None else done.unionByName(hit)
        if left.isEmpty():
            break
    if done is None:
        done = left.drop("a_hv", "b_hv").withColumns({"via": F.lit(None).cast("long"), "path": F.lit(None).cast("double")})
    fit = creative_fit(F.col("sim"))
    score = F.col("fit") * (0.5 + F.col("path")) * (0.5 + F.col("conf")) * F.when(F.col("latent"), LATENT).otherwise(1.0)
    return checkpointed(done.withColumn("fit", fit).withColumn("score", score))


def _via(pairs: DataFrame, block: list, least: float, bits: int) -> DataFrame:
    """`pairs` with the first node of the block that both ends are linked to, and the weaker of both links."""
    spaces: dict[str, list] = {}
    for r in block:
        spaces.setdefault(r["part"], []).append(r)
    sent = pairs.sparkSession.sparkContext.broadcast({p: (np.array([r["id"] for r in own], np.int64), recall.matrix(pd.Series([r["hv"] for r in own]))) for p, own in spaces.items()})
    far = np.count_nonzero(1.0 - np.arange(bits + 1) / bits >= least) - 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            via, path = np.full(len(batch), -1), np.full(len(batch), np.nan)
            found = np.zeros(len(batch), bool)
            for p, at in batch.groupby("part", sort=False).indices.items():
                if p not in sent.value:
                    continue
                ids, m = sent.value[p]
                a, b = recall.matrix(batch["a_hv"].iloc[at]), recall.matrix(batch["b_hv"].iloc[at])
                open_ = np.arange(len(at))
                for low in range(0, len(ids), VIA_STEP):
                    for some in (open_[i : i + recall.PAIR_STRIP] for i in range(0, len(open_), recall.PAIR_STRIP)):
                        d = np.maximum(recall.differing(a[some], m[low : low + VIA_STEP]), recall.differing(b[some], m[low : low + VIA_STEP]))
                        near = d <= far
                        hit, first = near.any(1), near.argmax(1)
                        row = at[some[hit]]
                        found[row], via[row], path[row] = True, ids[low + first[hit]], 1.0 - d[hit, first[hit]] / bits
                    open_ = open_[~found[at[open_]]]
            yield batch.assign(via=pd.Series(via).astype("Int64").where(pd.Series(found)), path=pd.Series(path).where(pd.Series(found)))

    kind = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(find, f"{kind}, via long, path double")
