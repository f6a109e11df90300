"""Features of long demand series (unique_id, ds, y) and measurements on them.

A series has at most one row per day, so windows over one series are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.constants import FEATURE_LAGS, INTERMITTENT_SHARE
from shelfcast.functions.calendar import day_of_week
from shelfcast.functions.numeric import share
from shelfcast.operators.scale import attach, exact_quantiles

FEATURE_COLUMNS = (
    *[f"lag_{n}" for n in FEATURE_LAGS],
    "rolling_mean_7", "rolling_std_7", "rolling_mean_28", "day_of_week", "month", "day_of_year",
)
KEYS = ("unique_id", "ds", "y")


def demand_features(demand: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Lags, rolling statistics of the days before, and calendar columns; one exchange serves all windows."""
    series = Window.partitionBy(*keys).orderBy("ds")

    def before(days: int):
        return series.rowsBetween(-days, -1)

    return demand.select(
        "*",
        *[F.lag("y", n).over(series).alias(f"lag_{n}") for n in FEATURE_LAGS],
        F.avg("y").over(before(7)).alias("rolling_mean_7"),
        F.coalesce(F.stddev_samp("y").over(before(7)), F.lit(0.0)).alias("rolling_std_7"),
        F.avg("y").over(before(28)).alias("rolling_mean_28"),
        day_of_week(F.col("ds")).alias("day_of_week"),
        F.month("ds").alias("month"),
        F.dayofyear("ds").alias("day_of_year"),
    )


#: Feature groups by name: a function of demand (unique_id, ds, y) that gives (unique_id, ds, columns of the group).
_GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_group(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Add a feature group that ``feature_table`` joins where it is asked for."""
    _GROUPS[name] = build


def feature_table(demand: DataFrame, future: DataFrame | None = None, past: DataFrame | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Demand features with known-ahead and observed drivers and registered groups joined on series and day."""
    unknown = [g for g in groups if g not in _GROUPS]
    if unknown:
        raise ValueError(f"Unknown feature groups: {unknown}. Available: {sorted(_GROUPS)}")
    out = demand_features(demand)
    for name in groups:
        out = out.join(_GROUPS[name](demand), ["unique_id", "ds"], "left")
    if future is not None:
        out = out.join(future.select("unique_id", "ds", "promo_flag", "is_holiday", "temperature"), ["unique_id", "ds"], "left")
    if past is not None:
        out = out.join(past.select("unique_id", "ds", "price", "stock_level"), ["unique_id", "ds"], "left")
    return out


def training_slice(features: DataFrame, ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of some series between two days, both inclusive."""
    out = features
    if ids is not None:
        out = out.where(F.col("unique_id").isin(list(ids)))
    if start is not None:
        out = out.where(F.col("ds") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("ds") <= F.lit(end).cast("date"))
    return out


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEYS]


def latest_features(features: DataFrame) -> DataFrame:
    """Newest feature row per series, the batch form of the online lookup."""
    rest = [c for c in features.columns if c not in ("unique_id", "ds")]
    newest = F.max_by(F.struct("ds", *rest), "ds").alias("f")
    return features.groupBy("unique_id").agg(newest).select("unique_id", "f.ds", *[f"f.{c}" for c in rest])


def upsert_features(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keep the newest row per series of two feature tables; a fresh row wins on equal days."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    order = F.struct("ds", "__new")
    newest = F.max_by(F.struct(*[c for c in both.columns if c not in ("unique_id", "__new")]), order).alias("f")
    return both.groupBy("unique_id").agg(newest).select("unique_id", "f.*")


def series_profile(demand: DataFrame, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Days and share of zero days per series."""
    return demand.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(F.when(F.col("y") == 0, 1.0).otherwise(0.0)).alias("zero_share")
    )


def dataset_statistics(demand: DataFrame) -> DataFrame:
    """One row: sizes, intermittent share, mean, median and share of zero days."""
    profile = series_profile(demand).agg(
        F.count(F.lit(1)).alias("n_skus"),
        F.count(F.when(F.col("zero_share") > INTERMITTENT_SHARE, 1)).alias("n_intermittent_skus"),
    )
    totals = demand.agg(
        F.count(F.lit(1)).alias("total_rows"), F.countDistinct("ds").alias("n_days"),
        F.avg("y").alias("mean_demand"), share(F.col("y") == 0).alias("zero_demand_pct"),
    )
    median = exact_quantiles(demand, F.col("y"), {"median_demand": 0.5})
    one = F.lit(1)
    joined = totals.withColumn("one", one).join(profile.withColumn("one", one), "one").join(median.withColumn("one", one), "one")
    return joined.drop("one").withColumn(
        "intermittent_pct", F.col("n_intermittent_skus") / F.greatest(F.col("n_skus"), F.lit(1)) * 100
    )


def censored_days(demand: DataFrame, past: DataFrame) -> DataFrame:
    """Days without demand on which nothing was in stock, so demand may have been lost."""
    return demand.join(past.select("unique_id", "ds", "stock_level"), ["unique_id", "ds"]).where("y = 0 and stock_level = 0")


def promotion_lift(demand: DataFrame, future: DataFrame) -> DataFrame:
    return demand.join(future.select("unique_id", "ds", "promo_flag"), ["unique_id", "ds"]).groupBy("promo_flag").agg(
        F.count(F.lit(1)).alias("days"), F.avg("y").alias("mean_demand")
    )


def price_elasticity(facts: DataFrame, by: str = "category") -> DataFrame:
    """Slope of log demand on log price per group."""
    return facts.where("y > 0 and price > 0").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.ln("y"), F.ln("price")).alias("elasticity")
    )


def substitution_effect(facts: DataFrame, promo: Column) -> DataFrame:
    """Mean demand of a series on days when other members of its subcategory are on promotion, against other days.

    The number of other promoted members is the group's count minus the row's own flag, so no member pairs are built.
    """
    group = ["warehouse", "category", "subcategory", "ds"]
    flagged = facts.withColumn("own", promo.cast("int"))
    totals = flagged.groupBy(*group).agg(F.sum("own").alias("promoted"))
    others = F.col("promoted") - F.col("own")
    return attach(flagged, totals, group).where("own = 0").groupBy(
        "category", F.when(others > 0, "peer promoted").otherwise("no peer promoted").alias("peers")
    ).agg(F.count(F.lit(1)).alias("days"), F.avg("y").alias("mean_demand"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of a table: row count and two independent sums over row hashes."""
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    digest = F.sha2(text, 256)
    part = [F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(20,0)") for i in (1, 13)]
    return df.select(part[0].alias("a"), part[1].alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("a").cast("string").alias("hash_a"), F.sum("b").cast("string").alias("hash_b")
    )
