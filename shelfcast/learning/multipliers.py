"""Safety-stock multiplier per category that minimises holding plus expected shortage cost.

The cost is separable and piecewise linear in each multiplier, and holding (0.25 per unit) is cheaper than shortage
(2 per unit), so the best multiplier is where the shortage just vanishes, kept inside the allowed range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.5, 3.0


def category_means(clean: DataFrame) -> DataFrame:
    return clean.groupBy("Category").agg(
        F.avg("Daily_Demand_Est").alias("demand"), F.avg("Unit_Cost").alias("cost"), F.avg("Safety_Stock_Target").alias("safety"),
        F.avg("Lead_Time_Days").alias("lead"), F.count(F.lit(1)).alias("skus"),
    )


def cost_of(multiplier: Column) -> Column:
    stock = F.col("safety") * multiplier
    shortage = F.greatest(F.lit(0.0), F.col("demand") * F.col("lead") * 0.5 - stock)
    return (stock * 0.25 + shortage * 2) * F.col("cost") * F.col("skus")


def best_multipliers(means: DataFrame) -> DataFrame:
    ideal = F.when(F.col("safety") > 0, F.col("demand") * F.col("lead") * 0.5 / F.col("safety")).otherwise(LOW)
    best = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), ideal))
    out = means.withColumn("multiplier", best)
    return out.select(
        "Category", "multiplier", cost_of(F.lit(1.0)).alias("current_cost"), cost_of(F.col("multiplier")).alias("optimal_cost")
    )


def grid_multipliers(means: DataFrame, steps: int = 250) -> DataFrame:
    """The same search over an even grid, as a check of the closed form."""
    grid = means.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn(
        "multiplier", F.lit(LOW) + F.col("i") * ((HIGH - LOW) / steps)
    ).withColumn("c", cost_of(F.col("multiplier")))
    return grid.groupBy("Category").agg(F.min("c").alias("optimal_cost"), F.min_by("multiplier", F.struct("c", "multiplier")).alias("multiplier"))


def savings(best: DataFrame) -> DataFrame:
    row = best.agg(F.sum("current_cost").alias("current_cost"), F.sum("optimal_cost").alias("optimal_cost"))
    saved = F.col("current_cost") - F.col("optimal_cost")
    return row.withColumn("savings", saved).withColumn("savings_pct", F.when(F.col("current_cost") > 0, saved / F.col("current_cost") * 100).otherwise(0.0))
