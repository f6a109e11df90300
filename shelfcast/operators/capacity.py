"""Production capacity against demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import constants as K
from shelfcast.functions.numeric import ratio
from shelfcast.operators.scale import scalars


def default_profiles(spark: SparkSession, lines: int = K.PRODUCTION_LINES, efficiency: float = K.UTILIZATION_TARGET) -> DataFrame:
    """Lines of growing throughput."""
    i = F.col("id")
    return spark.range(lines).select(
        F.concat(F.lit("LINE-"), F.lpad((i + 1).cast("string"), 2, "0")).alias("line_id"),
        F.concat(F.lit("group_"), F.char(i + 65)).alias("product_group"),
        (1000.0 * (1.0 + i * 0.2)).alias("max_throughput_per_day"),
        F.lit(2.0).alias("changeover_time_hours"),
        F.lit(efficiency).alias("efficiency_factor"),
    )


def daily_capacity(profiles: DataFrame) -> Column:
    """Sum of throughput times efficiency, as a column for any frame."""
    return scalars(profiles, c=F.sum(F.col("max_throughput_per_day") * F.col("efficiency_factor")))["c"]


def weekly_buckets(demand: DataFrame) -> DataFrame:
    """Name the week of each (ds, demand) row W1, W2, ... from the first day on."""
    first = scalars(demand, d=F.min("ds"))["d"]
    week = F.floor(F.date_diff("ds", first) / 7) + 1
    return demand.withColumn("period", F.concat(F.lit("W"), week.cast("string")))


def snapshot_demand(clean: DataFrame, weeks: int = 4) -> DataFrame:
    """Weekly demand of an inventory snapshot, repeated over a short horizon."""
    total = clean.agg((F.sum("Daily_Demand_Est") * 7).alias("demand"))
    return total.select(F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("w"), "demand").select(
        F.concat(F.lit("W"), F.col("w").cast("string")).alias("period"), "demand"
    )


def utilization(demand: DataFrame, capacity_per_day: Column, days: int = 7) -> DataFrame:
    """Demand, capacity, utilisation (capped at 2 for reporting), colour class and deficit per period."""
    per_period = demand.groupBy("period").agg(F.sum("demand").alias("demand"))
    sized = per_period.withColumn("capacity", capacity_per_day * float(days))
    used = F.when(F.col("capacity") > 0, F.col("demand") / F.col("capacity")).otherwise(F.lit(float("inf")))
    capped = F.least(used, F.lit(2.0))
    colour = F.when(capped > 1.0, "over capacity").when(capped > K.UTILIZATION_TARGET, "above target").otherwise("ok")
    return sized.select(
        "period", "demand", "capacity", used.alias("raw_utilization"), capped.alias("utilization"), colour.alias("state"),
        (F.col("demand") - F.col("capacity")).alias("deficit"),
    )


def bottlenecks(used: DataFrame) -> DataFrame:
    return used.where("raw_utilization > 1").select(
        "period", F.lit("ALL").alias("line_id"), "demand", "capacity", "deficit", F.col("raw_utilization").alias("utilization")
    )


def feasibility(used: DataFrame) -> DataFrame:
    """One report row; no demand at all is feasible."""
    row = used.agg(
        F.coalesce(F.avg("utilization"), F.lit(0.0)).alias("avg_utilization"),
        F.coalesce(F.max("utilization"), F.lit(0.0)).alias("max_utilization"),
        F.count(F.when(F.col("raw_utilization") > 1, 1)).alias("bottleneck_count"),
        F.sum("demand").alias("d"), F.sum("capacity").alias("c"),
    )
    cover = F.least(F.lit(1.0), ratio(F.col("c"), F.col("d"), 1.0))
    return row.select(
        (F.col("bottleneck_count") == 0).alias("feasible"), "avg_utilization", "max_utilization", "bottleneck_count",
        cover.alias("demand_coverage"),
    )


def adjustments(found: DataFrame, lines: int = K.PRODUCTION_LINES) -> DataFrame:
    """Overtime when it covers the deficit, else outsourcing."""
    weekly = lines * K.MAX_OVERTIME_HOURS * (1000.0 / K.SHIFT_HOURS) * 7
    fits = F.col("deficit") <= weekly
    return found.select(
        "period", "deficit", F.when(fits, "overtime").otherwise("outsource").alias("action"),
        F.when(fits, F.lit(weekly)).otherwise(F.col("deficit")).alias("additional_capacity"),
        F.when(fits, F.lit(K.MAX_OVERTIME_HOURS * K.CHANGEOVER_COST_PER_HOUR * 7))
        .otherwise(F.col("deficit") * K.OUTSOURCE_UNIT_COST)
        .alias("estimated_cost"),
    )
