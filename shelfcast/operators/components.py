"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import pin


def _joined_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest v of its u. Minima are combined before the shuffle; the join may be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _joined_min(both).withColumn("m", F.least("u", "m")).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _joined_min(edges)
    others = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(linked.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root): every node that is not the smallest of its component, with that smallest node.

    ``edges`` has columns u > v of one orderable type. Large-star and small-star steps alternate until nothing moves,
    which takes a number of rounds near the logarithm of the longest path. Each round is written to the shared folder, so
    a lost executor replays one round. A node with a third of all edges is a minimum that combines early and a join
    side that adaptive execution splits.
    """
    edges, before = pin(edges.distinct(), "edges"), None
    for _ in range(most_rounds):
        edges = pin(_small_star(_large_star(edges)).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            return edges.select("u", F.col("v").alias("root"))
        before = state
    raise RuntimeError("components did not settle; raise most_rounds")


def forest(n: int, left, right):
    """The smallest row number of each row's component inside one task, by pointer jumping."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(label, before):
            return label
