"""Inventory-value regressors and the residuals of the best one."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.learning.prepare import scaled
from shelfcast.operators.statistics import adjusted_skew


def regressors() -> dict:
    return {
        "Linear Regression": LinearRegression(),
        "RF Regressor": RandomForestRegressor(numTrees=100, seed=42),
        "GB Regressor": GBTRegressor(maxIter=100, maxDepth=3, seed=42),
    }


def predictions(train: DataFrame, test: DataFrame, models: dict) -> dict[str, DataFrame]:
    return {name: scaled(m).fit(train).transform(test) for name, m in models.items()}


def compare(predicted: dict[str, DataFrame]) -> DataFrame:
    rows = []
    for name, df in predicted.items():
        rows.append((name, *[float(RegressionEvaluator(metricName=m).evaluate(df)) for m in ("r2", "rmse")]))
    spark = next(iter(predicted.values())).sparkSession
    return spark.createDataFrame(rows, "model string, r2 double, rmse double")


def best(scores: DataFrame) -> str:
    """Name of the model with the highest r2."""
    return scores.orderBy(F.col("r2").desc(), "model").first()["model"]


def residual_summary(predicted: DataFrame) -> DataFrame:
    r = predicted.select((F.col("label") - F.col("prediction")).alias("r"))
    return r.agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), adjusted_skew("r").alias("skew"),
        F.min("r").alias("low"), F.max("r").alias("high"),
    )
