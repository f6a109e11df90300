"""Unusual SKUs: isolation trees, reconstruction error, and how far the two agree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numeric import hash_fraction
from shelfcast.learning import reduce
from shelfcast.operators.scale import global_quantiles, scalars

SAMPLE = 256
TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree from a sample of a few hundred rows."""
    tree = int(pdf["tree"].iloc[0])
    data = np.stack(pdf.sort_values("key")["x"].to_numpy())
    rng = np.random.default_rng(tree)
    limit = math.ceil(math.log2(max(2, len(data))))
    nodes: list[list] = []
    todo = [(np.arange(len(data)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        number = len(nodes)
        nodes.append([tree, number, -1, 0.0, -1, -1, depth + expected_depth(len(rows))])
        if parent is not None:
            nodes[parent][side] = number
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(varied):
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        nodes[number][2:4] = [f, cut]
        below = data[rows, f] < cut
        todo += [(rows[below], depth + 1, number, 4), (rows[~below], depth + 1, number, 5)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])


def grow_forest(train: DataFrame, trees: int = 200, seed: int = 42, key: str = "Product_ID") -> DataFrame:
    """Node table of all trees. One hash picks the rows that are used at all, another sends each to one tree, so the
    data is read once and each tree sees about 256 rows."""
    n = scalars(train, n=F.count(F.lit(1)))["n"]
    rate = trees * SAMPLE / n.cast("double")
    # A small table is used as often as needed: each row may serve several trees.
    copies = F.greatest(F.lit(1), F.ceil(rate).cast("int"))
    rows = train.select(F.col(key).alias("key"), vector_to_array("features").alias("x")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies))
    )
    token = F.concat_ws("|", F.col("key"), F.col("copy"))
    used = rows.where(hash_fraction(token, seed) < rate / copies)
    return used.withColumn("tree", F.pmod(F.xxhash64(token, F.lit(seed)), F.lit(trees)).cast("int")).groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def isolation_scores(points: DataFrame, forest: DataFrame, key: str = "Product_ID") -> DataFrame:
    """Score per row: near 1 is isolated early, below 0.5 is ordinary. The forest has a fixed number of small trees,
    so it travels with the tasks."""
    table = forest.orderBy("tree", "node").toPandas()
    packed = [
        tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")) for _, g in table.groupby("tree", sort=True)
    ]
    norm = expected_depth(SAMPLE)
    schema = f"{key} string, score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy())
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, left, right, depth in packed:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[every, np.maximum(f, 0)] < cut[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                total += depth[at]
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-total / len(packed) / norm)})

    return points.select(key, vector_to_array("features").alias("x")).mapInPandas(score, schema)


def flag_top(scored: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """Mark the rows above the (1 - share) quantile of a score."""
    limit = global_quantiles(scored, F.col(column), {"q": 1 - share})["q"]
    return scored.withColumn(name, F.col(column) > limit)


def detect(train: DataFrame, test: DataFrame, trees: int = 200, rank: int = 6, key: str = "Product_ID") -> DataFrame:
    """Both detectors on the test rows: (key, score, is_isolated, error, is_unusual)."""
    isolated = flag_top(isolation_scores(test, grow_forest(train, trees), key), "score", 0.05, "is_isolated")
    errors = reduce.reconstruction_error(reduce.fit(train, rank), test).select(key, "error")
    return isolated.join(flag_top(errors, "error", 0.05, "is_unusual"), key)


def agreement(flags: DataFrame) -> DataFrame:
    a, b = F.col("is_isolated"), F.col("is_unusual")
    return flags.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(a & b, 1)).alias("both"), F.count(F.when(a & ~b, 1)).alias("only_isolation"),
        F.count(F.when(~a & b, 1)).alias("only_reconstruction"), F.count(F.when(~a & ~b, 1)).alias("neither"),
        (F.avg(F.when(a == b, 1.0).otherwise(0.0)) * 100).alias("agreement_pct"),
    )


def feature_ratios(rows: DataFrame, flag: str, names) -> DataFrame:
    """Mean of each feature among flagged rows over its mean among the others."""
    cells = [
        F.struct(
            F.lit(n).alias("feature"), F.avg(F.when(F.col(flag), F.col(n))).alias("unusual"), F.avg(F.when(~F.col(flag), F.col(n))).alias("usual")
        )
        for n in names
    ]
    long = rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    base = F.when(F.col("usual") == 0, 1e-9).otherwise(F.col("usual"))
    return long.withColumn("ratio", F.col("unusual") / base)
