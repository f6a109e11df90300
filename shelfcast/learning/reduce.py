"""Principal components of scaled snapshot features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.learning.prepare import REGRESSION_FEATURES


def fit(points: DataFrame, k: int):
    return PCA(k=k, inputCol="features", outputCol="pca").fit(points)


def components(points: DataFrame, k: int) -> DataFrame:
    """Scores on the first k components as an array column."""
    return fit(points, k).transform(points).withColumn("score", vector_to_array("pca")).drop("pca")


def explained(points: DataFrame, names=REGRESSION_FEATURES) -> DataFrame:
    """Variance share per component, cumulative share and the component that reaches 90 %."""
    shares = [float(v) for v in fit(points, len(names)).explainedVariance]
    rows, total, reached = [], 0.0, False
    for i, v in enumerate(shares, 1):
        total += v
        rows.append((i, v, total, not reached and total >= 0.9))
        reached = reached or total >= 0.9
    return points.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, reaches_90 boolean")


def loadings(points: DataFrame, names=REGRESSION_FEATURES) -> DataFrame:
    """Weight of each feature in the first two components; the sign is fixed by the largest weight."""
    matrix = np.array(fit(points, 2).pc.toArray())  # a copy: the model's own array is read-only
    for j in range(2):
        if matrix[abs(matrix[:, j]).argmax(), j] < 0:
            matrix[:, j] = -matrix[:, j]
    rows = [(n, float(matrix[i, 0]), float(matrix[i, 1])) for i, n in enumerate(names)]
    return points.sparkSession.createDataFrame(rows, "feature string, pc1 double, pc2 double")


def reconstruction_error(model, points: DataFrame) -> DataFrame:
    """Mean squared distance between a scaled row and its projection on the model's components."""
    x, z = vector_to_array("features"), vector_to_array("pca")

    def squares(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)

    scored = model.transform(points)
    return scored.withColumn("error", F.greatest(F.lit(0.0), (squares(x) - squares(z)) / F.size(x))).drop("pca")
