"""Supply and demand balance under planning scenarios.

Inventory with lost sales, inv[t] = max(0, inv[t-1] + supply[t] - demand[t]), has a closed form: with S the running
net supply on top of the opening stock, inv[t] = S[t] - min(0, min of S up to t). Two window passes, no loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast import constants as K
from shelfcast.functions.numeric import ratio
from shelfcast.operators.supply import uniform


def default_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(K.SOP_SCENARIOS)],
        "number int, scenario string, demand_multiplier double, capacity_multiplier double, supply_reliability double",
    )


def scenario_array(scenarios: DataFrame) -> Column:
    """The scenario table as one array value, so rows fan out without a join."""
    return scenarios.agg(F.collect_list(F.struct(*scenarios.columns))).scalar()


def resize_periods(demand: DataFrame, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """Repeat (or cut) a list of numbered periods 1..n cyclically to a fixed length."""
    size = Window.partitionBy(*keys)
    sized = demand.withColumn("n", F.max("period").over(size)) if keys else demand.withColumn(
        "n", demand.agg(F.max("period")).scalar()
    )
    laps = F.ceil(F.lit(periods) / F.col("n")).cast("int")
    wide = sized.select("*", F.explode(F.sequence(F.lit(0), laps - 1)).alias("lap"))
    return wide.select(*keys, (F.col("lap") * F.col("n") + F.col("period")).cast("int").alias("period"), "demand").where(
        F.col("period") <= periods
    )


def horizons(demand: DataFrame, keys: Sequence[str] = (), horizon_days: int = K.SOP_HORIZON_DAYS, bucket_days: int = K.SOP_BUCKET_DAYS) -> DataFrame:
    """All numbered periods cut into successive horizons (0, 1, ...), each numbered from 1; the last may be short."""
    periods = max(1, horizon_days // bucket_days)
    before = F.col("period") - 1
    return demand.select(*keys, F.floor(before / periods).cast("int").alias("horizon"), (before % periods + 1).cast("int").alias("period"), "demand")


def supply_factor(mode: str, seed: int, keys: Sequence[str]) -> Column:
    """Share of capacity that arrives: all of it with the scenario's reliability, else 70 %.

    ``always`` and ``expected`` are deterministic; ``random`` draws from a hash of scenario, period and seed.
    """
    if mode == "always":
        return F.lit(1.0)
    if mode == "expected":
        return F.col("supply_reliability") + (1 - F.col("supply_reliability")) * K.SOP_SHORT_SUPPLY
    draw = uniform(F.lit(seed), F.col("number"), F.col("period"), *[F.col(k) for k in keys])
    return F.when(draw < F.col("supply_reliability"), 1.0).otherwise(K.SOP_SHORT_SUPPLY)


def simulate(
    demand: DataFrame, capacity_per_day: Column, scenarios: DataFrame, keys: Sequence[str] = (), mode: str = "random",
    seed: int = 42, horizon_days: int = K.SOP_HORIZON_DAYS, bucket_days: int = K.SOP_BUCKET_DAYS,
) -> DataFrame:
    """Period rows of every scenario: demand, capacity, fulfilled, inventory, utilisation, stockout.

    ``demand`` is (keys, period 1..n, demand). With keys every key is balanced on its own.
    """
    periods = max(1, horizon_days // bucket_days)
    base = resize_periods(demand, periods, keys).withColumn("cap", capacity_per_day * float(bucket_days))
    each = base.select("*", F.explode(scenario_array(scenarios)).alias("s")).select(*keys, "period", "demand", "cap", "s.*")
    each = each.withColumn("demand", F.col("demand") * F.col("demand_multiplier")).withColumn(
        "capacity", F.col("cap") * F.col("capacity_multiplier")
    )
    each = each.withColumn("supply", F.col("capacity") * supply_factor(mode, seed, keys))
    path = Window.partitionBy("scenario", *keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.col("capacity") * K.SOP_OPENING_SHARE
    each = each.withColumn("net", opening + F.sum(F.col("supply") - F.col("demand")).over(path))
    each = each.withColumn("inventory", F.col("net") - F.least(F.lit(0.0), F.min("net").over(path)))
    before = F.coalesce(F.lag("inventory").over(Window.partitionBy("scenario", *keys).orderBy("period")), opening)
    each = each.withColumn("available", before + F.col("supply"))
    filled = F.least(F.col("demand"), F.col("available"))
    used = F.round(F.least(ratio(F.col("demand"), F.col("capacity"), 0.0), F.lit(2.0)), 3)
    missing = F.greatest(F.col("demand") - F.col("available"), F.lit(0.0))
    return each.select(
        "scenario", "number", *keys, "period", "demand", "capacity", filled.alias("fulfilled"), "inventory",
        used.alias("utilization"), (missing > 0).alias("stockout"), missing.alias("missing"),
        (F.col("inventory") * K.SOP_HOLDING_RATE * (bucket_days / 365) + missing * K.SOP_STOCKOUT_PENALTY).alias("cost"),
    )


def scenario_kpis(details: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fill rate, mean utilisation, cost, stockouts and whether the fill target is met."""
    row = details.groupBy("scenario", *keys).agg(
        F.sum("fulfilled").alias("f"), F.sum("demand").alias("d"), F.avg("utilization").alias("avg_utilization"),
        F.sum("cost").alias("inventory_cost"), F.count(F.when(F.col("stockout"), 1)).alias("stockout_events"),
        F.countDistinct("period").alias("periods"),
    )
    fill = ratio(F.col("f"), F.col("d"), 1.0)
    return row.select(
        "scenario", *keys, fill.alias("fill_rate"), "avg_utilization", "inventory_cost", "stockout_events", "periods",
        (fill >= K.SOP_TARGET_FILL).alias("meets_target"),
    )


def compare(kpis: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best scenario: highest fill rate, then lowest cost."""
    order = F.struct("fill_rate", -F.col("inventory_cost"))
    row = kpis.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scenarios_compared"), F.max_by("scenario", order).alias("best_scenario"),
        F.max("fill_rate").alias("best_fill_rate"),
    )
    return row.withColumn("target_met", F.col("best_fill_rate") >= K.SOP_TARGET_FILL)
