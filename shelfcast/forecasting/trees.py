"""Gradient-boosted trees on pooled lag features, forecast day by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecasting.closed_form import positions
from shelfcast.functions.calendar import day_of_week
from shelfcast.operators.features import FEATURE_COLUMNS, demand_features
from shelfcast.session import pin

HISTORY = 28
PIN_EVERY = 3

# Tree presets (trees, depth, learning rate); 31 leaves are a tree of depth five.
PRESETS = {
    "xgboost": {"iterations": 200, "depth": 5, "rate": 0.1},
    "lightgbm": {"iterations": 300, "depth": 5, "rate": 0.1},
}


def fit(demand: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, iterations: int = 200, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """One model over all series; rows without full history are left out."""
    rows = demand_features(demand).dropna(subset=list(FEATURE_COLUMNS))
    train = pin(rows.select(*features, F.col("y").cast("double").alias("label")), "train")
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTRegressor(maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed, labelCol="label")
    return Pipeline(stages=[assemble, trees]).fit(train)


def importances(model: PipelineModel, spark, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(name, float(v)) for name, v in zip(features, values, strict=True)], "feature string, importance double"
    )


def histories(demand: DataFrame) -> DataFrame:
    """Last day and the last 28 values of each series, oldest first."""
    return positions(demand, ["unique_id"]).where(F.col("back") < HISTORY).groupBy("unique_id").agg(
        F.max("ds").alias("ds"),
        F.expr("transform(array_sort(collect_list(struct(t, y))), x -> x.y)").alias("history"),
    )


def next_features(state: DataFrame) -> DataFrame:
    """Feature columns of the day after each state, by the same rules as in training."""
    h, size = F.col("history"), F.size("history")

    def lag(n: int) -> Column:
        return F.when(size >= n, F.element_at(h, -n)).otherwise(F.element_at(h, -1))

    def last(n: int) -> Column:
        return F.when(size >= n, F.slice(h, size - (n - 1), n)).otherwise(h)

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    week = last(7)
    spread = F.sqrt(F.aggregate(week, F.lit(0.0), lambda s, x: s + (x - mean(week)) * (x - mean(week))) / (F.size(week) - 1))
    out = state.withColumn("ds", F.date_add("ds", 1))
    return out.select(
        "*",
        *[lag(n).alias(f"lag_{n}") for n in (1, 7, 14, 28)],
        mean(week).alias("rolling_mean_7"),
        F.when(F.size(week) > 1, spread).otherwise(0.0).alias("rolling_std_7"),
        mean(last(28)).alias("rolling_mean_28"),
        day_of_week(F.col("ds")).alias("day_of_week"), F.month("ds").alias("month"), F.dayofyear("ds").alias("day_of_year"),
    )


def predict(model: PipelineModel, demand: DataFrame, horizon: int) -> DataFrame:
    """Recursive forecast. One row per series carries its last 28 values and the path so far.

    Lineage is cut every few steps; the finished paths are exploded once, so no step is computed twice.
    """
    state = histories(demand).withColumn("path", F.expr("cast(array() as array<struct<ds: date, y_hat: double>>)"))
    for step in range(1, horizon + 1):
        scored = model.transform(next_features(state)).withColumn("y_hat", F.greatest(F.lit(0.0), F.col("prediction")))
        longer = F.concat("history", F.array("y_hat"))
        trimmed = F.when(F.size(longer) > HISTORY, F.slice(longer, F.size(longer) - (HISTORY - 1), HISTORY)).otherwise(longer)
        state = scored.select(
            "unique_id", "ds", trimmed.alias("history"), F.concat("path", F.array(F.struct("ds", "y_hat"))).alias("path")
        )
        if step % PIN_EVERY == 0 or step == horizon:
            state = pin(state, "path")
    return state.select("unique_id", F.explode("path").alias("p")).select("unique_id", "p.ds", "p.y_hat")
