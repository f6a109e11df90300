"""Near-term demand signals: weights, forecast adjustment, spikes and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast import constants as K
from shelfcast.functions.text import last_word
from shelfcast.operators.scale import attach, scalars


def signal_weight(horizon: int = K.SENSING_HORIZON_DAYS, half_life: int = K.DECAY_HALF_LIFE_DAYS, planning: int = K.SENSING_HORIZON_DAYS) -> Column:
    """Source weight x confidence x horizon factor x recency decay; a timestamp without a day counts as day 0."""
    source = F.col("source")
    known = None
    for name, w in K.SOURCE_WEIGHTS.items():
        known = F.when(source == name, w) if known is None else known.when(source == name, w)
    base = known.otherwise(K.UNKNOWN_SOURCE_WEIGHT)
    day = F.coalesce(F.element_at(F.split("timestamp", "_"), -1).try_cast("int"), F.lit(0))
    last_day = horizon - 1 if horizon > 1 else 1
    age = F.greatest(F.lit(0), last_day - day)
    decay = F.pow(F.lit(0.5), age / float(max(1, half_life)))
    return base * F.col("confidence") * max(0.1, 1.0 - horizon / (planning * 2)) * decay


def product_signal(signals: DataFrame, horizon: int = K.SENSING_HORIZON_DAYS) -> DataFrame:
    """Weighted mean signal per product; partial sums, so a product with most signals is no bottleneck."""
    w = signals.withColumn("w", signal_weight(horizon))
    return w.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("signal_value")).alias("weighted")
    ).where("weight <> 0").select("product_id", "signals", (F.col("weighted") / F.col("weight")).alias("signal"))


def adjust_forecast(base_forecast: DataFrame, signals: DataFrame, blend: float = K.SIGNAL_BLEND) -> DataFrame:
    """70 % base, 30 % signal; a product without signals keeps its forecast."""
    joined = attach(base_forecast, product_signal(signals).select("product_id", "signal"), ["product_id"])
    base = F.col("forecast")
    adjusted = F.coalesce(base * (1 - blend) + F.col("signal") * blend, base)
    return joined.withColumn("adjusted_forecast", adjusted).withColumn(
        "adjustment_pct", F.when(F.col("signal").isNotNull() & (base > 0), (adjusted - base) / base * 100).otherwise(0.0)
    ).drop("signal")


def spikes(signals: DataFrame, sigma: float = K.SPIKE_SIGMA) -> DataFrame:
    """Signals more than ``sigma`` sample deviations above their product's mean; one signal alone is never a spike."""
    stats = signals.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("signal_value").alias("mean"), F.stddev_samp("signal_value").alias("sd")
    ).where("n >= 2 and sd > 0")
    scored = signals.join(stats, "product_id").withColumn("sigma", (F.col("signal_value") - F.col("mean")) / F.col("sd"))
    return scored.where(F.col("sigma") > sigma).drop("n", "mean", "sd")


def base_forecast(clean: DataFrame, products: DataFrame) -> DataFrame:
    """Mean daily demand of the snapshot as the first-period forecast of every given product."""
    mean = scalars(clean, m=F.avg("Daily_Demand_Est"))["m"]
    return products.select("product_id", F.lit(1).alias("period"), mean.alias("forecast"))


def sensing_kpis(signals: DataFrame, found: DataFrame, adjusted: DataFrame) -> DataFrame:
    n_signals = scalars(signals, n=F.count(F.lit(1)))["n"]
    n_spikes = scalars(found, n=F.count(F.lit(1)))["n"]
    return adjusted.agg(
        F.coalesce(F.avg(F.abs("adjustment_pct")), F.lit(0.0)).alias("avg_adjustment_pct"), F.count(F.lit(1)).alias("products_sensed")
    ).select(n_signals.alias("active_signals"), n_spikes.alias("spike_count"), "avg_adjustment_pct", "products_sensed")


def signal_timeline(signals: DataFrame, sources: list[str], n: int = 100) -> DataFrame:
    """The first n signals by event number, numbered within their source."""
    first = signals.where(F.col("source").isin(sources)).orderBy("event_id").limit(n)
    return first.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("event_id")))


def short_source(col: Column) -> Column:
    return last_word(col)
