"""Forecast models that Spark aggregations express fully.

Each model maps (demand, horizon, keys) to (keys, ds, y_hat). ``keys`` may hold more than the series, so all folds
of a walk-forward evaluation run as one job. Forecasts are never negative.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.constants import EWM_LOOKBACK, N_HARMONICS, NAIVE_WINDOW, SEASON_PERIOD

SERIES = ("unique_id",)


def ahead(fits: DataFrame, keys: Sequence[str], horizon: int, y_hat: Column) -> DataFrame:
    """One row per future day; ``y_hat`` may use ``step`` (1, 2, ...) and any column of ``fits``."""
    steps = fits.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, F.date_add("last_ds", F.col("step")).alias("ds"), F.greatest(F.lit(0.0), y_hat).alias("y_hat"))


def positions(demand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add t (0, 1, ... in day order), n and the position from the end (0 is the last day)."""
    series = Window.partitionBy(*keys).orderBy("ds")
    whole = Window.partitionBy(*keys)
    t = F.row_number().over(series) - 1
    return demand.select(
        *keys, "ds", F.col("y").cast("double").alias("y"), t.alias("t"), F.count(F.lit(1)).over(whole).alias("n")
    ).withColumn("back", F.col("n") - 1 - F.col("t"))


def naive(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, window: int = NAIVE_WINDOW) -> DataFrame:
    """Mean of the last ``window`` values, flat."""
    fits = positions(demand, keys).where(F.col("back") < window).groupBy(*keys).agg(
        F.avg("y").alias("flat"), F.max("ds").alias("last_ds")
    )
    return ahead(fits, keys, horizon, F.col("flat"))


def zero_shot(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """For series without history: mean of the last 30 values."""
    return naive(demand, horizon, keys, 30)


#: Rows of a series that these models read; an evaluation copies no more into its folds.
naive.lookback = NAIVE_WINDOW
zero_shot.lookback = 30


def weighted_trend(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, lookback: int = EWM_LOOKBACK) -> DataFrame:
    """Exponentially weighted mean of all history plus the slope of the last ``lookback`` values."""
    alpha = 2.0 / (F.least(F.lit(lookback), F.col("n")) + 1)
    weight = F.pow(1 - alpha, F.col("back"))
    recent = F.col("back") < lookback
    fits = positions(demand, keys).withColumn("w", weight).groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("flat"),
        F.coalesce(F.regr_slope(F.when(recent, F.col("y")), F.when(recent, F.col("t"))), F.lit(0.0)).alias("slope"),
        F.max("ds").alias("last_ds"),
    )
    return ahead(fits, keys, horizon, F.col("flat") + F.col("slope") * F.col("step"))


def trend_harmonics(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, harmonics: int = N_HARMONICS) -> DataFrame:
    """Quadratic trend plus harmonics of the residual.

    With u = t - (n-1)/2 the odd moments vanish, so the least-squares parabola is closed form, and the residual's
    cosine and sine sums follow from sums of y, 1, u and u^2 against each wave: one aggregation per series.
    """
    n = F.col("n").cast("double")
    rows = positions(demand, keys).withColumn("u", F.col("t") - (n - 1) / 2).withColumn(
        "period", F.least(F.lit(float(SEASON_PERIOD)), n / 2)
    )

    def angle(k: int, at: Column) -> Column:
        return F.lit(2 * math.pi * k) * at / F.col("period")

    u2 = F.col("u") * F.col("u")
    sums = {"sy": F.col("y"), "suy": F.col("u") * F.col("y"), "su2y": u2 * F.col("y"), "su2": u2, "su4": u2 * u2}
    for k in range(1, harmonics + 1):
        for tag, wave in (("c", F.cos(angle(k, F.col("t")))), ("s", F.sin(angle(k, F.col("t"))))):
            for name, v in (("y", F.col("y")), ("1", F.lit(1.0)), ("u", F.col("u")), ("u2", u2)):
                sums[f"{tag}{k}_{name}"] = wave * v
    fits = rows.groupBy(*keys).agg(
        *[F.sum(v).alias(name) for name, v in sums.items()],
        F.max("n").alias("n"), F.max("period").alias("period"), F.max("ds").alias("last_ds"),
    )
    bend = n * F.col("su4") - F.col("su2") * F.col("su2")
    fits = (
        fits.withColumn("a2", F.when(F.col("n") >= 3, (n * F.col("su2y") - F.col("su2") * F.col("sy")) / bend).otherwise(0.0))
        .withColumn("a1", F.when(F.col("n") >= 2, F.try_divide(F.col("suy"), F.col("su2"))).otherwise(0.0))
        .withColumn("a0", (F.col("sy") - F.col("a2") * F.col("su2")) / n)
    )
    # The time index of the k-th future day is n + k - 1.
    at = F.col("n") + F.col("step") - 1
    u = at - (n - 1) / 2
    y_hat = F.col("a0") + F.col("a1") * u + F.col("a2") * u * u
    for k in range(1, harmonics + 1):
        for tag, wave in (("c", F.cos(angle(k, at))), ("s", F.sin(angle(k, at)))):
            left = F.col(f"{tag}{k}_y")
            for coef, name in (("a0", "1"), ("a1", "u"), ("a2", "u2")):
                left = left - F.col(coef) * F.col(f"{tag}{k}_{name}")
            y_hat = y_hat + 2.0 * left / n * wave
    return ahead(fits, keys, horizon, y_hat)


def seasonal_trend(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Additive decomposition: last trend value, slope of the whole series and the seasonal mean of the phase.

    The trend is a centred moving average, continued at both ends by a line through the nearest ``period`` points.
    Series too short to decompose use the mean of their last 30 values.
    """
    series = Window.partitionBy(*keys).orderBy("ds")
    short = F.when(F.col("n") >= 4, F.least(F.lit(SEASON_PERIOD), F.floor(F.col("n") / 2))).otherwise(2).cast("int")
    rows = positions(demand, keys).withColumn("period", short)

    centre = None
    for p in range(2, SEASON_PERIOD + 1):
        half = p // 2
        inner = F.sum("y").over(series.rowsBetween(-(half if p % 2 else half - 1), half if p % 2 else half - 1))
        if p % 2 == 0:
            inner = inner + 0.5 * (F.lag("y", half).over(series) + F.lead("y", half).over(series))
        is_p = F.col("period") == p
        centre = F.when(is_p, inner / p) if centre is None else centre.when(is_p, inner / p)
    half = F.floor(F.col("period") / 2)
    full = (F.col("t") >= half) & (F.col("back") >= half)
    rows = rows.withColumn("ma", F.when(full, centre))

    last = F.col("n") - 1 - half
    head = (F.col("t") >= half) & (F.col("t") < F.least(half + F.col("period"), last))
    tail = (F.col("t") >= F.greatest(half, last - F.col("period"))) & (F.col("t") < last)
    whole = Window.partitionBy(*keys)

    def line(part: Column, name: str, df: DataFrame) -> DataFrame:
        """Slope and intercept of the moving average over some positions; a single point gives the shortest solution."""
        t, m = F.when(part, F.col("t").cast("double")), F.when(part, F.col("ma"))
        df = df.withColumn(f"{name}_k", F.regr_slope(m, t).over(whole)).withColumn(f"{name}_c", F.regr_intercept(m, t).over(whole))
        t1, m1 = F.max(t).over(whole), F.max(m).over(whole)
        return df.withColumn(f"{name}_c", F.coalesce(f"{name}_c", m1 / (t1 * t1 + 1))).withColumn(
            f"{name}_k", F.coalesce(f"{name}_k", m1 * t1 / (t1 * t1 + 1))
        )

    rows = line(tail, "tail", line(head, "head", rows))
    trend = F.coalesce(
        "ma",
        F.when(F.col("t") < half, F.col("head_k") * F.col("t") + F.col("head_c")).otherwise(
            F.col("tail_k") * F.col("t") + F.col("tail_c")
        ),
    )
    rows = rows.withColumn("trend", trend).withColumn("phase", (F.col("t") % F.col("period")).cast("int"))
    phases = rows.groupBy(*keys, "phase").agg(
        F.avg(F.col("y") - F.col("trend")).alias("mean"),
        F.max("period").alias("period"), F.max("n").alias("n"), F.max("ds").alias("last_ds"),
        F.max(F.when(F.col("back") == 0, F.col("trend"))).alias("last_trend"),
        F.count("y").alias("c"), F.sum("t").alias("st"), F.sum("y").alias("sy"),
        F.sum(F.col("t") * F.col("y")).alias("sty"), F.sum(F.col("t") * F.col("t")).alias("stt"),
        F.sum(F.when(F.col("back") < 30, F.col("y"))).alias("recent"),
        F.count(F.when(F.col("back") < 30, 1)).alias("recent_n"),
    )
    cells = F.array_sort(F.collect_list(F.struct("phase", "mean")))  # at most one cell per phase
    fits = phases.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("period").alias("period"), F.max("last_ds").alias("last_ds"),
        F.max("last_trend").alias("last_trend"), cells.alias("season"), F.avg("mean").alias("centre"),
        F.sum("st").alias("st"), F.sum("sy").alias("sy"), F.sum("sty").alias("sty"), F.sum("stt").alias("stt"),
        (F.sum("recent") / F.sum("recent_n")).alias("flat"),
    )
    n = F.col("n").cast("double")
    slope = F.try_divide(n * F.col("sty") - F.col("st") * F.col("sy"), n * F.col("stt") - F.col("st") * F.col("st"))
    index = ((F.col("n") + F.col("step") - 1) % F.col("period")).cast("int")
    seasonal = F.get(F.col("season"), index).getField("mean") - F.col("centre")
    y_hat = F.when(F.col("n") >= 2 * F.col("period"), F.col("last_trend") + slope * F.col("step") + seasonal).otherwise(F.col("flat"))
    return ahead(fits, keys, horizon, y_hat)
