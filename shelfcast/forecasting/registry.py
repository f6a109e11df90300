"""Forecast models by name, routing between them, and batch forecasts with bands."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import constants as K
from shelfcast.forecasting import closed_form, regression, trees
from shelfcast.forecasting.closed_form import SERIES, positions
from shelfcast.operators.features import series_profile

Model = Callable[..., DataFrame]


def _boosted(preset: str) -> Model:
    def run(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, **options) -> DataFrame:
        if tuple(keys) != SERIES:
            raise ValueError("tree models are fitted for one training set at a time")
        settings = {**trees.PRESETS[preset], **options}
        return trees.predict(trees.fit(demand, **settings), demand, horizon)

    return run


_MODELS: dict[str, Model] = {
    "naive_ma30": closed_form.naive,
    "sarimax": regression.seasonal_ar,
    "xgboost": _boosted("xgboost"),
    "lightgbm": _boosted("lightgbm"),
    "chronos2_zs": closed_form.zero_shot,
    "prophet": closed_form.seasonal_trend,
    "lstm": closed_form.weighted_trend,
    "nbeats": closed_form.trend_harmonics,
    "tft": regression.ridge,
}
#: Models that run all folds in one job.
FOLDABLE = ("naive_ma30", "sarimax", "chronos2_zs", "prophet", "lstm", "nbeats", "tft")


#: Models that the router chooses from.
ROUTED = ("chronos2_zs", "sarimax", "lightgbm")


def available_models() -> list[str]:
    return [*_MODELS, "routing_ensemble"]


def register(name: str, model: Model) -> None:
    """Add a model: a function of (demand, horizon, keys) giving (keys, ds, y_hat)."""
    _MODELS[name] = model


#: Rows that one series may have for a model that is fitted series by series: three centuries of days.
MOST_ROWS = 100_000


def series_model(fit: Callable[[pd.DataFrame], object], predict: Callable[[object, int], Sequence[float]], most_rows: int = MOST_ROWS, lookback: int | None = None) -> Model:
    """A model from plain functions of one series: ``fit`` gets its rows (ds, y) in order of day, ``predict`` gives the
    values of the coming days. Series are fitted side by side where their rows are; one of more than ``most_rows`` ends the
    run with an error that names it. ``lookback`` says how many last rows ``fit`` needs, all if None."""

    def run(demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES) -> DataFrame:
        def one(key: tuple, table: pa.Table) -> pa.Table:
            if table.num_rows > most_rows:
                raise ValueError(f"series {key} has {table.num_rows} rows, more than {most_rows}")
            rows = table.select(["ds", "y"]).to_pandas().sort_values("ds", ignore_index=True)
            values = [max(0.0, float(v)) for v in predict(fit(rows), horizon)]
            last = rows["ds"].iloc[-1]
            out = {k: pa.array([v.as_py() if hasattr(v, "as_py") else v] * len(values), table.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
            return pa.table(out | {"ds": pa.array([last + dt.timedelta(days=i + 1) for i in range(len(values))], pa.date32()), "y_hat": pa.array(values, pa.float64())})

        rows = demand.select(*keys, F.col("ds").cast("date").alias("ds"), F.col("y").cast("double").alias("y"))
        types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        return rows.groupBy(*keys).applyInArrow(one, f"{types}, ds date, y_hat double")

    if lookback is not None:
        run.lookback = lookback
    return run


def create(name: str) -> Model:
    if name == "routing_ensemble":
        return routed_forecast
    if name not in _MODELS:
        raise ValueError(f"Unknown model: {name}. Available: {available_models()}")
    return _MODELS[name]


def create_all() -> dict[str, Model]:
    return {name: create(name) for name in available_models()}


def route(days: Column, zero_share: Column, cold_days: int | Column = K.COLD_START_DAYS, intermittent: float = K.INTERMITTENT_SHARE) -> Column:
    """Model name for a series: short history, then many zero days, then mature."""
    return (
        F.when(days < cold_days, "chronos2_zs").when(zero_share > intermittent, "sarimax").otherwise("lightgbm")
    )


def assign(demand: DataFrame, keys: Sequence[str] = SERIES, cold_days: int = K.COLD_START_DAYS, intermittent: float = K.INTERMITTENT_SHARE) -> DataFrame:
    return series_profile(demand, keys).withColumn("model", route(F.col("n_days"), F.col("zero_share"), cold_days, intermittent))


def routing_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("model").agg(F.count(F.lit(1)).alias("series"))


def routed_forecast(
    demand: DataFrame, horizon: int, keys: Sequence[str] = SERIES, models: dict[str, Model] | None = None, **thresholds
) -> DataFrame:
    """Forecast each series with the model it is routed to; the model name is kept."""
    assigned = assign(demand, keys, **thresholds)
    labelled = demand.join(assigned.select(*keys, "model"), list(keys))
    out = None
    for name in ROUTED:
        model = (models or {}).get(name) or create(name)
        part = model(labelled.where(F.col("model") == name).drop("model"), horizon, keys).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# The order in which a missing model is replaced.
FALLBACK_ORDER = ("lightgbm", "xgboost", "sarimax", "naive_ma30")


def with_fallback(assigned: DataFrame, available: Sequence[str]) -> DataFrame:
    """Replace a routed model that is not available by the first available one in the fallback order."""
    spare = next((m for m in FALLBACK_ORDER if m in available), None)
    keep = F.col("model").isin(list(available))
    return assigned.withColumn("model_used", F.when(keep, F.col("model")).otherwise(F.lit(spare)))


def with_bands(forecasts: DataFrame, demand: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """95 % bands from the spread of the last 30 values; the lower band may be negative."""
    spread = positions(demand, keys).where("back < 30").groupBy(*keys).agg(F.stddev_pop("y").alias("sd"))
    return forecasts.join(spread, list(keys)).select(
        *forecasts.columns, (F.col("y_hat") - 1.96 * F.col("sd")).alias("lower"), (F.col("y_hat") + 1.96 * F.col("sd")).alias("upper")
    )


def stale_fallback(expected: DataFrame, fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Fresh forecast where there is one, else the previous run's, flagged as stale."""
    keys = ["unique_id", "ds"]
    f = fresh.select(*keys, F.col("y_hat").alias("fresh"))
    p = previous.select(*keys, F.col("y_hat").alias("older"))
    return expected.select(*keys).join(f, keys, "left").join(p, keys, "left").select(
        *keys, F.coalesce("fresh", "older").alias("y_hat"), (F.col("fresh").isNull() & F.col("older").isNotNull()).alias("is_stale")
    )
