"""Per-series regressions: Spark makes the normal equations, a vectorised batch step solves and rolls them forward.

After the aggregation there is one small row per series, so the Python step sees series, never observations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfcast.constants import SEASON_PERIOD
from shelfcast.forecasting.closed_form import SERIES, naive, positions
from shelfcast.functions.calendar import day_of_week

RIDGE_FEATURES = ("t", "dow", "month", "lag1", "lag7")
RIDGE_MIN_DAYS = 4
AR_MIN_DAYS = 14


def forecast_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField("ds", T.DateType()), T.StructField("y_hat", T.DoubleType())])


def tail_values(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Last n values of each series, oldest first, with its last day and its length."""
    return rows.where(F.col("back") < n).groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(struct(t, y))), x -> x.y)").alias("tail"),
        F.max("ds").alias("last_ds"), F.max("n").alias("n"),
    )


def roll_forward(pdf: pd.DataFrame, keys: Sequence[str], horizon: int, paths: np.ndarray) -> pd.DataFrame:
    """Lay a (series, horizon) matrix of forecasts out as rows."""
    out = pdf[list(keys)].loc[pdf.index.repeat(horizon)].reset_index(drop=True)
    start = pd.to_datetime(pdf["last_ds"]).to_numpy("datetime64[D]")
    days = start[:, None] + np.arange(1, horizon + 1)[None, :].astype("timedelta64[D]")
    out["ds"] = pd.Series(days.ravel().astype("datetime64[ns]")).dt.date
    out["y_hat"] = paths.ravel()
    return out


def ridge(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, penalty: float = 1.0) -> DataFrame:
    """Ridge regression on trend, weekday, month, yesterday and last week, rolled forward day by day.

    Missing lags take the series mean. Series under four days forecast their mean.
    """
    series = Window.partitionBy(*keys).orderBy("ds")
    rows = positions(demand, keys).withColumn("mean_y", F.avg("y").over(Window.partitionBy(*keys)))
    rows = rows.select(
        *keys, "ds", "y", "n", "back", F.col("t").cast("double").alias("t"),
        day_of_week(F.col("ds")).cast("double").alias("dow"), F.month("ds").cast("double").alias("month"),
        F.coalesce(F.lag("y", 1).over(series), F.col("mean_y")).alias("lag1"),
        F.coalesce(F.lag("y", 7).over(series), F.col("mean_y")).alias("lag7"),
    )
    names = RIDGE_FEATURES
    cross = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    fits = rows.groupBy(*keys).agg(
        F.array(*cross).alias("xx"), F.array(*[F.covar_pop(a, "y") for a in names]).alias("xy"),
        F.array(*[F.avg(a) for a in names]).alias("xm"), F.avg("y").alias("ym"),
    )
    fits = fits.join(tail_values(rows, keys, SEASON_PERIOD), list(keys))
    low = np.tril_indices(len(names))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            m, k = len(pdf), len(names)
            n = pdf["n"].to_numpy(float)
            gram = np.zeros((m, k, k))
            gram[:, low[0], low[1]] = np.stack(pdf["xx"].to_numpy()) * n[:, None]
            gram = gram + np.transpose(np.tril(gram, -1), (0, 2, 1)) + penalty * np.eye(k)
            xm, ym = np.stack(pdf["xm"].to_numpy()), pdf["ym"].to_numpy(float)
            w = np.linalg.solve(gram, (np.stack(pdf["xy"].to_numpy()) * n[:, None])[..., None])[..., 0]
            flat = n < RIDGE_MIN_DAYS
            # A short history repeats its first value on the left, which is what a too-long lag falls back to.
            hist = np.stack([np.concatenate([np.full(SEASON_PERIOD - len(v), v[0]), v]) for v in pdf["tail"]])
            start = pd.to_datetime(pdf["last_ds"])
            path = np.empty((m, horizon))
            for step in range(horizon):
                day = start + pd.Timedelta(days=step + 1)
                x = np.column_stack([n + step, day.dt.dayofweek, day.dt.month, hist[:, -1], hist[:, -7]]).astype(float)
                y = np.maximum(0.0, np.where(flat, ym, ym + ((x - xm) * w).sum(axis=1)))
                path[:, step] = y
                hist = np.column_stack([hist[:, 1:], y])
            yield roll_forward(pdf, keys, horizon, path)

    return fits.mapInPandas(solve, forecast_schema(demand, keys))


def seasonal_ar(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Autoregression on values differenced by one day and one week, with lags of one day and one week.

    Least squares from three product sums per lag. Series under fourteen days get the mean of their values instead.
    """
    short = positions(demand, keys).where(F.col("n") < AR_MIN_DAYS).select(*keys, "ds", "y")
    series = Window.partitionBy(*keys).orderBy("ds")

    def back(n: int):
        return F.lag("y", n).over(series)

    rows = positions(demand, keys).where(F.col("n") >= AR_MIN_DAYS)
    rows = rows.withColumn("z", F.col("y") - back(1) - back(7) + back(8))
    rows = rows.withColumn("z1", F.lag("z", 1).over(series)).withColumn("z7", F.lag("z", 7).over(series))
    sums = {"s11": ("z1", "z1"), "s17": ("z1", "z7"), "s77": ("z7", "z7"), "s1y": ("z1", "z"), "s7y": ("z7", "z")}
    known = F.col("z7").isNotNull()
    fits = rows.groupBy(*keys).agg(
        *[F.sum(F.when(known, F.col(a) * F.col(b))).alias(name) for name, (a, b) in sums.items()]
    ).join(tail_values(rows, keys, 2 * SEASON_PERIOD + 1), list(keys))
    det = F.col("s11") * F.col("s77") - F.col("s17") * F.col("s17")
    usable = det > 1e-9 * F.col("s11") * F.col("s77")
    fits = fits.select(
        *keys, "tail", "last_ds",
        F.when(usable, (F.col("s1y") * F.col("s77") - F.col("s7y") * F.col("s17")) / det).otherwise(0.0).alias("p1"),
        F.when(usable, (F.col("s7y") * F.col("s11") - F.col("s1y") * F.col("s17")) / det).otherwise(0.0).alias("p7"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = 2 * SEASON_PERIOD + 1
        for pdf in batches:
            if pdf.empty:
                continue
            p1, p7 = pdf["p1"].to_numpy(float), pdf["p7"].to_numpy(float)
            y = np.stack([np.concatenate([np.full(width - len(v), v[0]), v]) for v in pdf["tail"]])
            z = y[:, 8:] - y[:, 7:-1] - y[:, 1:-7] + y[:, :-8]
            path = np.empty((len(pdf), horizon))
            for step in range(horizon):
                nz = p1 * z[:, -1] + p7 * z[:, -7]
                ny = nz + y[:, -1] + y[:, -7] - y[:, -8]
                path[:, step] = np.maximum(0.0, ny)
                y, z = np.column_stack([y, ny]), np.column_stack([z, nz])
            yield roll_forward(pdf, keys, horizon, path)

    return fits.mapInPandas(solve, forecast_schema(demand, keys)).unionByName(naive(short, horizon, keys).select(*keys, "ds", "y_hat"))
