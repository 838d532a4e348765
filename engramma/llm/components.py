"""Connected components of an edge table, by propagating the least label and jumping along labels.

Each round joins edges with labels read from a stored table, so adaptive execution
can split a hub's partition, and combines with a map-side `min`; rounds grow with the
logarithm of the longest path.  Nothing is collected but one count a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.common import drop_stored, store


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. Edges are (u, v) of longs; self-loops do no harm."""
    both = store(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        named = labels.join(heard, labels.node == heard.u, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        named = store(named)
        up = named.select(F.col("node").alias("r"), F.col("root").alias("up"))
        jumped = named.join(up, named.root == up.r, "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = store(jumped)
        moved = new.where("root <> old").limit(1).count()
        drop_stored(named, labels)
        labels = new.select("node", "root")
        if not moved:
            return labels


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of a spanning forest of the links x-y: one for each node but the roots."""
    nodes, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = back[: len(x)], back[len(x) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[label[i]])) for i in range(len(nodes)) if label[i] != i]
