"""Clusters of SKUs: k-means with a choice of k, bisecting k-means, and density clusters by a metric index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import STATUS_LOW, STATUS_NORMAL, STATUS_OUT
from shelfcast.functions.numeric import share
from shelfcast.learning.metric import SLACK, Index, asking, build, meet, window
from shelfcast.operators.components import connected, forest
from shelfcast.session import pin


def kmeans_search(points: DataFrame, ks: range = range(2, 11), seed: int = 42) -> DataFrame:
    """Within-cluster cost and silhouette for each k, with the best k marked."""
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(points)
        rows.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(points)))))
    best = max(rows, key=lambda r: r[2])[0]
    return points.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, inertia double, silhouette double, best boolean")


def kmeans_labels(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol="features").fit(points).transform(points)


def hierarchical_labels(points: DataFrame, k: int, seed: int = 42, tries: int = 5) -> DataFrame:
    """Top-down hierarchy (bisecting k-means). An unlucky start can fail to split, so up to ``tries`` seeds are used."""
    best = None
    for s in range(seed, seed + tries):
        model = BisectingKMeans(k=k, seed=s, maxIter=20, featuresCol="features").fit(points)
        if best is None or len(model.clusterCenters()) > len(best.clusterCenters()):
            best = model
        if len(best.clusterCenters()) == k:
            break
    return best.transform(points)


def status_by_cluster(labelled: DataFrame) -> DataFrame:
    s = F.col("Stock_Status")
    return labelled.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("skus"), share(s == STATUS_NORMAL).alias("normal_pct"),
        share(s == STATUS_LOW).alias("low_pct"), share(s == STATUS_OUT).alias("out_pct"),
    )


def profiles(labelled: DataFrame, names) -> DataFrame:
    """Mean scaled feature per cluster, long."""
    x = vector_to_array("features")
    wide = labelled.select("prediction", *[x.getItem(i).alias(n) for i, n in enumerate(names)])
    return wide.groupBy("prediction").agg(*[F.avg(n).alias(n) for n in names]).unpivot(["prediction"], list(names), "feature", "mean")


def density_clusters(points: DataFrame, eps: float = 2.5, min_points: int = 10, key: str = "Product_ID", tile: int = 2048) -> DataFrame:
    """Density clusters (DBSCAN) of the points themselves, in all dimensions: (key, cluster), -1 for noise.

    A point is a core point if at least ``min_points`` points, itself included, are within ``eps``. Core points within
    ``eps`` of each other share a cluster; another point joins the cluster with the smallest root among its core
    neighbours. Neighbours come from a metric index; equal points are one weighted node.

    Points within half of ``eps`` of a centre are all neighbours of each other, so where they weigh enough they are core points
    of one cluster without being compared. Other points count such balls whole where they lie inside ``eps``, and only those
    that stay in doubt ask the rows of the cells around. Core points then ask only cells that hold a core point of another
    cluster so far, and a task hands on one link for each cluster that it joins.
    """
    nodes = pin(points.select(F.col(key).cast("string").alias("key"), vector_to_array("features").alias("x")).groupBy("x").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")), "nodes")
    size = nodes.count()
    cells = max(1, min(4096, max(int(np.sqrt(size)), min(2048, size // 32))))
    index = build(nodes, cells=cells, tile=tile, crowded=cells // 4)
    if index is None:
        return points.select(key, F.lit(-1).cast("long").alias("cluster"))
    count, high, low = index.count, index.high, index.low

    def reachable(d: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        return np.where(count > 0, np.maximum(np.maximum(d - high, low - d), 0.0), np.inf) <= eps * (1 + SLACK) + SLACK

    def near(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of ``b`` (sorted by r) within ``eps`` of each row of ``a``."""
        rows, r = np.stack(b["x"].to_list()), b["r"].to_numpy()
        for i, (x, d) in enumerate(zip(a["x"], a["d"], strict=True)):
            span = window(r, d, eps)
            hit = np.flatnonzero(np.sqrt(((rows[span] - x) ** 2).sum(axis=1)) <= eps)
            yield i, hit + span.start

    def total(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "total": []}).astype({"key": object, "total": np.int64})
        b = b.sort_values("r", ignore_index=True)
        n = b["n"].to_numpy()
        return pd.DataFrame({"key": a["key"].to_numpy(), "total": [int(n[hit].sum()) for _, hit in near(a, b)]})

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}).astype(object)
        b = b.sort_values("r", ignore_index=True)
        names, at = np.unique(np.concatenate([a["root"].to_numpy(), b["root"].to_numpy()]).astype(str), return_inverse=True)
        label = np.arange(len(names))
        left, right = [], []
        for i, hit in near(a, b):
            left.append(np.full(len(hit), at[i]))
            right.append(at[len(a) + hit])
            if sum(map(len, left)) > 1_000_000:
                # Links found so far become one per cluster before more are gathered.
                label = forest(len(names), np.concatenate([*left, np.arange(len(names))]), np.concatenate([*right, label]))
                left, right = [], []
        label = forest(len(names), np.concatenate([*left, np.arange(len(names))]), np.concatenate([*right, label]))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})

    def joined(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("r", ignore_index=True)
            root = b["root"].to_numpy()
            out = [(a["key"].iloc[i], min(root[hit])) for i, hit in near(a, b) if len(hit)]
        return pd.DataFrame(out, columns=["key", "root"])

    balls = _balls(index, eps, min_points)
    half, bare = balls.half, replace(index, frame=None)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whether a row is a core point for sure, and the clusters of balls that it surely is in reach of."""
        for batch in batches:
            cell = batch["cell"].to_numpy()
            packed = balls.dense[cell] & (batch["r"].to_numpy() <= half)
            sure, known = packed.copy(), [[str(balls.name[c])] if p else [] for c, p in zip(cell, packed, strict=True)]
            loose = np.flatnonzero(~packed)
            for at in np.array_split(loose, max(1, -(-len(loose) * len(count) // 4_000_000))):
                if not len(at):
                    continue
                d = bare.away(np.stack(batch["x"].iloc[at].to_list()))
                sure[at] = ((d + balls.radius <= eps * (1 - SLACK) - SLACK) @ balls.weight) >= min_points
                close = (d <= eps * (1 - SLACK) - SLACK) & balls.dense
                for i, row in zip(at, close, strict=True):
                    known[i] = sorted({str(n) for n in balls.name[row]})
            yield batch.assign(sure=sure & batch["key"].notna().to_numpy(), known=known)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.frame.schema.fields)
    first = pin(index.frame.mapInPandas(judge, f"{types}, sure boolean, known array<string>"), "judged")
    doubtful = first.where("not sure").select("key", "x")
    sums = meet(index, asking(index, doubtful, reachable), total, "key string, total long").groupBy("key").agg(F.sum("total").alias("total"))
    counted = first.where("not sure").join(sums, "key").withColumn("sure", F.col("total") >= min_points).drop("total")
    judged = pin(first.where("sure").unionByName(counted).withColumnRenamed("sure", "core"), "judged")
    other = judged.where("not core").select("key", "x")
    # Clusters so far carry the smallest key of a ball, or the key of a core point that is in reach of none.
    core = pin(judged.where("core").withColumn("root", F.coalesce(F.try_element_at("known", F.lit(1)), "key")), "cores")
    core = pin(_renamed(core, core.select(F.explode(F.expr("slice(known, 2, greatest(size(known) - 1, 0))")).alias("u"), F.col("root").alias("v"))).withColumn("code", F.xxhash64("root")), "cores")
    least, most = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    held = np.zeros(len(count), bool)
    for s in core.groupBy("cell").agg(F.min("code").alias("least"), F.max("code").alias("most")).collect():
        least[s["cell"]], most[s["cell"]], held[s["cell"]] = s["least"], s["most"], True

    def differing(d: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        code = part["code"].to_numpy()[:, None]
        return held & ((least != code) | (most != code)) & reachable(d, part)

    cores = replace(index, frame=core)
    asked = asking(index, core.select("key", "x", "root", "code"), differing, lambda part: np.full(len(part), eps))
    rooted = pin(_renamed(core, meet(cores, asked, links, "u string, v string")).select("key", "x", "root"), "core-roots")
    named = replace(index, frame=index.frame.join(rooted.select("key", "root"), "key"))
    border = meet(named, asking(index, other, reachable), joined, "key string, root string").groupBy("key").agg(F.min("root").alias("root"))
    placed = rooted.select("x", "root").unionByName(other.join(border, "key", "left").select("x", "root"))
    number = F.when(F.col("root").isNotNull(), F.pmod(F.xxhash64("root"), F.lit(1 << 40))).otherwise(-1)
    return points.select(key, vector_to_array("features").alias("x")).join(placed, "x").select(key, number.alias("cluster"))


@dataclass
class Balls:
    """Per cell the rows within half of eps of the centre: their radius and weight, whether they are core points, their cluster."""

    half: float
    radius: np.ndarray
    weight: np.ndarray
    dense: np.ndarray
    name: np.ndarray


def _balls(index: Index, eps: float, min_points: int) -> Balls:
    cells, half = len(index.centres), eps / 2 * (1 - SLACK) - SLACK
    radius, weight, dense = np.full(cells, np.inf), np.zeros(cells), np.zeros(cells, bool)
    name = np.full(cells, "", object)
    inner = index.frame.where(F.col("r") <= half).groupBy("cell")
    for s in inner.agg(F.max("r").alias("r"), F.sum("n").alias("n"), F.min("key").alias("key"), F.count(F.when(F.col("key").isNull(), 1)).alias("unnamed")).collect():
        c = s["cell"]
        radius[c], weight[c], name[c] = s["r"], s["n"], s["key"]
        dense[c] = s["n"] >= min_points and not s["unnamed"]
    # A centre is a row of its ball, so balls whose centres are within eps are one cluster, which takes its smallest key.
    label = np.arange(cells)
    for a in range(0, cells, 256):
        left, right = np.nonzero((index.away(index.centres[a : a + 256]) <= eps * (1 - SLACK) - SLACK) & dense & dense[a : a + 256, None])
        label = forest(cells, np.concatenate([left + a, np.arange(cells)]), np.concatenate([right, label]))
    for c in np.unique(label[dense]):
        own = dense & (label == c)
        name[own] = min(name[own])
    return Balls(half, radius, weight, dense, name)


def _renamed(core: DataFrame, edges: DataFrame) -> DataFrame:
    """``core`` with the smallest name of each cluster after the links of ``edges``, pairs u > v of names."""
    smaller = connected(edges).select(F.col("u").alias("root"), F.col("root").alias("least"))
    return core.join(smaller, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")


def cluster_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
        F.count(F.when(F.col("cluster") < 0, 1)).alias("noise"), F.count(F.lit(1)).alias("points"),
    )
