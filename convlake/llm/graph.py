"""Connected components, in one task (arrays) and over the cluster (large-star, small-star)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, reads, stash


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given links, and the smallest node each can reach; by labels that halve their paths."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        if (low == label[x]).all() and (low == label[y]).all():
            break
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def connected_components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); root is the smallest node it can reach.

    Alternating large-star and small-star: each step is a minimum by node (combined before its shuffle) and a join
    back on the node. A hub's rows are one side of a plain join, which adaptive execution splits. Each round is
    written to the shared folder, so the plan does not grow, and the one before deleted. Self links and repeated links are fine.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stash(large.distinct(), name)
        discard(edges)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stash(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return reads(roots.unionByName(own), edges)
