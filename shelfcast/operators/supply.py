"""Supply-chain analysis: order quantities, vendor scores, stockout risk, replenishment and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast import constants as K
from shelfcast.functions.numeric import clip, cut, equal_width_bin, hits, ratio, share
from shelfcast.operators.inventory import enrich_base
from shelfcast.operators.scale import exact_quantiles, global_quantiles, scalars, top_rows

def is_out() -> Column:
    return F.col("Stock_Status") == K.STATUS_OUT


def enrich_supply(clean: DataFrame) -> DataFrame:
    """Annual demand, reorder gap, economic order quantity, orders per year and total yearly cost."""
    annual, holding = F.col("Annual_Demand"), F.col("Holding_Cost")
    eoq = F.when((annual > 0) & (holding > 0), F.sqrt(2 * annual * K.ORDERING_COST / holding)).otherwise(0.0)
    return (
        enrich_base(clean)
        .withColumn("Annual_Demand", F.col("Daily_Demand_Est") * 365)
        .withColumn("Reorder_Gap", F.col("Current_Stock") - F.col("Reorder_Point"))
        .withColumn("Holding_Cost", F.col("Unit_Cost") * K.HOLDING_RATE)
        .withColumn("EOQ", eoq)
        .withColumn("Annual_Orders", ratio(annual, F.col("EOQ"), 0.0))
        .withColumn(
            "Total_Inventory_Cost", F.col("EOQ") / 2 * holding + F.col("Annual_Orders") * K.ORDERING_COST
        )
    )


def valid_orders(supply: DataFrame) -> DataFrame:
    """Rows with a positive order quantity below the 99th percentile of all rows, zeros included."""
    p99 = global_quantiles(supply, F.col("EOQ"), {"p": 0.99})["p"]
    return supply.where((F.col("EOQ") > 0) & (F.col("EOQ") < p99))


def eoq_by_category(valid: DataFrame) -> DataFrame:
    spread = exact_quantiles(valid, F.col("EOQ"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["Category"])
    plain = valid.groupBy("Category").agg(
        F.count(F.lit(1)).alias("skus"), F.min("EOQ").alias("low"), F.max("EOQ").alias("high")
    )
    return spread.join(plain, "Category")


def eoq_curve(valid: DataFrame, points: int = 200) -> DataFrame:
    """Theoretical order quantity over annual demand at the median holding cost."""
    holding = global_quantiles(valid, F.col("Holding_Cost"), {"m": 0.5})["m"]
    top = valid.agg(F.max("Annual_Demand").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"), "top").select(
        "step", (1 + F.col("step") * (F.col("top") - 1) / (points - 1)).alias("annual_demand")
    ).select("step", "annual_demand", F.sqrt(2 * F.col("annual_demand") * K.ORDERING_COST / holding).alias("eoq"))


def cost_breakdown(valid: DataFrame) -> DataFrame:
    return valid.groupBy("Category").agg(
        F.sum(F.col("EOQ") / 2 * F.col("Holding_Cost")).alias("holding"),
        F.sum(F.col("Annual_Orders") * K.ORDERING_COST).alias("ordering"),
    )


def cost_curve(skus: DataFrame, points: int = 500, key: str = "Product_ID") -> DataFrame:
    """Holding, ordering and total cost over order quantities from 10 to half the annual demand, per SKU."""
    d, h = F.col("Annual_Demand"), F.col("Holding_Cost")
    steps = skus.select(
        key, "Annual_Demand", "Holding_Cost", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")
    )
    quantity = 10 + F.col("step") * (d * 0.5 - 10) / (points - 1)
    return steps.withColumn("quantity", quantity).select(
        key, "step", "quantity",
        (F.col("quantity") / 2 * h).alias("holding"),
        (d / F.col("quantity") * K.ORDERING_COST).alias("ordering"),
        (F.col("quantity") / 2 * h + d / F.col("quantity") * K.ORDERING_COST).alias("total"),
    )


def category_curves(skus: DataFrame, points: int = 500) -> DataFrame:
    """The cost curves of all SKUs of a category added up, step by step; sums combine before the shuffle."""
    return cost_curve(skus, points, "Category").groupBy("Category", "step").agg(
        F.avg("quantity").alias("quantity"), F.sum("holding").alias("holding"), F.sum("ordering").alias("ordering"), F.sum("total").alias("total")
    )


def orders_per_year(valid: DataFrame) -> DataFrame:
    """SKU counts by whole orders per year, capped at weekly ordering."""
    capped = clip(F.col("Annual_Orders"), high=52)
    return valid.groupBy(F.floor(capped).cast("int").alias("orders_per_year")).agg(F.count(F.lit(1)).alias("skus"))


def monthly_savings(valid: DataFrame) -> DataFrame:
    """Yearly cost saved against ordering every month, per category, never below zero for a SKU."""
    monthly = F.col("Annual_Demand") / 12 / 2 * F.col("Holding_Cost") + 12 * K.ORDERING_COST
    return valid.groupBy("Category").agg(
        F.sum(clip(monthly - F.col("Total_Inventory_Cost"), 0)).alias("savings")
    )


def vendor_scores(enriched: DataFrame) -> DataFrame:
    """Mean of six min-max scaled vendor metrics (0.5 when constant), and the vendor's rank."""
    raw = enriched.groupBy("Vendor_Name").agg(
        F.avg("Unit_Cost").alias("unit_cost"),
        F.avg("Stock_Coverage_Ratio").alias("coverage"),
        share(is_out()).alias("oos_rate"),
        F.avg("Lead_Time_Days").alias("lead_time"),
        F.avg("Inventory_Value").alias("value"),
        F.count("Product_ID").cast("double").alias("sku_count"),
    )
    lower_is_better = {"unit_cost": True, "coverage": False, "oos_rate": True, "lead_time": True, "value": False, "sku_count": False}
    ends = scalars(
        raw,
        **{f"{m}_{side}": fn(m) for m in lower_is_better for side, fn in (("lo", F.min), ("hi", F.max))},
    )
    scaled = []
    for m, invert in lower_is_better.items():
        lo, hi = ends[f"{m}_lo"], ends[f"{m}_hi"]
        unit = (F.col(m) - lo) / (hi - lo)
        scaled.append(F.when(hi > lo, (1 - unit) if invert else unit).otherwise(0.5).alias(m))
    parts = raw.select("Vendor_Name", *scaled)
    # Mean over the metrics a vendor has, as a missing one is left out.
    present = [F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in lower_is_better]
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in lower_is_better), F.lit(0.0))
    return parts.withColumn("score", total / sum(present, F.lit(0)))


def ranked_vendors(scores: DataFrame, n: int) -> DataFrame:
    return top_rows(scores, [F.col("score").desc(), F.col("Vendor_Name").asc_nulls_last()], n)


def value_composition(df: DataFrame) -> DataFrame:
    """Value by category and by category and vendor in one rollup, with the share of all value."""
    cells = df.rollup("Category", "Vendor_Name").agg(
        F.grouping_id().alias("level"), F.sum("Inventory_Value").alias("value")
    )
    whole = scalars(df, value=F.sum("Inventory_Value"))["value"]
    return cells.withColumn("value_pct", F.col("value") / whole * 100)


def simulation_parameters(clean: DataFrame, top: int | None = None) -> DataFrame:
    """Demand and lead-time moments per category, or only of the ``top`` categories by value."""
    moving = F.col("Daily_Demand_Est") > 0

    def when_moving(fn, c):
        return fn(F.when(moving, F.col(c)))

    params = clean.groupBy("Category").agg(
        F.sum("Inventory_Value").alias("value"),
        when_moving(F.avg, "Daily_Demand_Est").alias("demand_mean"),
        when_moving(F.stddev_samp, "Daily_Demand_Est").alias("demand_sd"),
        when_moving(F.avg, "Lead_Time_Days").alias("lead_mean"),
        when_moving(F.stddev_samp, "Lead_Time_Days").alias("lead_sd"),
        when_moving(F.avg, "Current_Stock").alias("avg_stock"),
    )
    if top:
        params = params.orderBy(F.col("value").desc(), "Category").limit(top)

    def spread(sd: str, mean: str) -> Column:
        fallback = F.greatest(F.col(mean) * 0.1, F.lit(1.0))
        return F.greatest(F.when(F.col(sd).isNull() | (F.col(sd) == 0), fallback).otherwise(F.col(sd)), F.lit(1.0))

    return params.withColumn("demand_sd", spread("demand_sd", "demand_mean")).withColumn(
        "lead_sd", spread("lead_sd", "lead_mean")
    )


def uniform(*parts: Column) -> Column:
    """Fraction in (0, 1) fixed by the hashed parts, so a retried task draws the same numbers."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal_pair(seed: int, *parts: Column) -> tuple[Column, Column]:
    """Two independent standard normal draws from hashes (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.ln(uniform(F.lit(seed), F.lit("radius"), *parts)))
    angle = 2 * F.lit(3.141592653589793) * uniform(F.lit(seed), F.lit("angle"), *parts)
    return radius * F.cos(angle), radius * F.sin(angle)


def numbered(params: DataFrame, name: str, n: int) -> DataFrame:
    return params.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias(name))


def lead_time_stockouts(params: DataFrame, n: int = K.MONTE_CARLO_TRIALS, seed: int = 42, key: str = "Category") -> DataFrame:
    """Share of simulated lead times whose demand exceeds the mean stock."""
    z1, z2 = normal_pair(seed, F.col(key), F.col("trial"))
    lead = F.floor(clip(F.col("lead_mean") + F.col("lead_sd") * z1, 1, 60))
    demand = clip(F.col("demand_mean") + F.col("demand_sd") * z2, 0)
    return (
        numbered(params, "trial", n)
        .withColumn("need", lead * demand)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("trials"),
            share(F.col("need") > F.col("avg_stock")).alias("stockout_pct"),
            F.avg("need").alias("mean_need"),
        )
    )


def daily_sum_stockouts(
    params: DataFrame, lead_days: int = 7, n: int = K.MONTE_CARLO_TRIALS, seed: int = 7, bins: int = 15, key: str = "Category"
) -> DataFrame:
    """Histogram of demand summed day by day over a lead time, with the stockout share, per key."""
    z, _ = normal_pair(seed, F.col(key), F.col("trial"), F.col("day"))
    day_need = clip(F.col("demand_mean") + F.col("demand_sd") * z, 0)
    draws = numbered(numbered(params, "trial", n), "day", lead_days)
    sums = draws.groupBy(key, "trial").agg(F.sum(day_need).alias("need"), F.max("avg_stock").alias("stock"))
    ends = sums.groupBy(key).agg(
        F.min("need").alias("lo"), F.max("need").alias("hi"), share(F.col("need") > F.col("stock")).alias("stockout_pct")
    )
    placed = sums.join(ends, key).withColumn("bin", equal_width_bin(F.col("need"), F.col("lo"), F.col("hi"), bins))
    return placed.groupBy(key, "bin").agg(
        F.count(F.lit(1)).alias("trials"), F.max("stockout_pct").alias("stockout_pct")
    )


def reorder_gap_spread(supply: DataFrame) -> DataFrame:
    return exact_quantiles(supply, F.col("Reorder_Gap"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["Category"])


def most_urgent(supply: DataFrame, n: int = 25) -> DataFrame:
    return top_rows(supply.where("Reorder_Gap < 0"), [F.col("Reorder_Gap"), F.col("Product_ID")], n)


def replenishment(supply: DataFrame) -> DataFrame:
    """SKUs below their reorder point: how much is missing and what it costs."""
    return supply.where("Reorder_Gap < 0").withColumn("Urgency", -F.col("Reorder_Gap")).withColumn(
        "Replenishment_Cost", F.col("Urgency") * F.col("Unit_Cost")
    )


def replenishment_budget(supply: DataFrame) -> DataFrame:
    return replenishment(supply).groupBy("Category").agg(
        F.sum("Replenishment_Cost").alias("total_cost"), F.count("Product_ID").alias("sku_count")
    )


def demand_variability(df: DataFrame) -> DataFrame:
    table = df.groupBy("Category").agg(
        F.avg("Daily_Demand_Est").alias("demand_mean"),
        F.stddev_samp("Daily_Demand_Est").alias("demand_std"),
        F.avg("Unit_Cost").alias("cost_mean"),
        F.avg("Safety_Stock_Target").alias("avg_safety"),
        F.avg("Current_Stock").alias("avg_stock"),
        F.avg("Lead_Time_Days").alias("avg_lead"),
        F.count("Product_ID").alias("sku_count"),
        share(is_out()).alias("oos_rate"),
    )
    return table.withColumn("cv", ratio(F.col("demand_std"), F.col("demand_mean"), 0.0))


# The coverage bands, as (label, above, up to).
COVERAGE_BANDS = (
    (">3x Safety Stock", 3.0, None),
    ("2-3x Safety Stock", 2.0, 3.0),
    ("1-2x Safety Stock", 1.0, 2.0),
    ("0.5-1x (At Risk)", 0.5, 1.0),
    ("<0.5x (Critical)", 0.0, 0.5),
)


def coverage_funnel(enriched: DataFrame) -> DataFrame:
    """SKU counts per coverage band plus the SKUs with no stock; stock without a safety target is in no band."""
    cov = F.col("Stock_Coverage_Ratio")
    counts = []
    for label, low, high in COVERAGE_BANDS:
        inside = cov > low if high is None else (cov > low) & (cov <= high)
        counts.append(F.struct(F.lit(label).alias("band"), hits(inside).alias("skus")))
    counts.append(F.struct(F.lit("Zero Stock").alias("band"), hits(F.col("Current_Stock") == 0).alias("skus")))
    row = enriched.agg(F.array(*counts).alias("bands"), F.count(F.lit(1)).alias("total"))
    return row.select(F.explode("bands").alias("b"), "total").select(
        "b.band", "b.skus", (F.col("b.skus") / F.col("total") * 100).alias("pct")
    )


def service_levels(enriched: DataFrame, points: int = 200, top: float = 5.0) -> DataFrame:
    """Percent of SKUs whose coverage reaches each of evenly spaced ratios.

    Each row falls in one grid cell, so the data is scanned once and only the grid is accumulated.
    """
    step = top / (points - 1)
    cell = F.least(F.floor(F.col("Stock_Coverage_Ratio") / step), F.lit(points - 1)).cast("int")
    # Guard the division against rounding at a grid point.
    cell = F.when(F.col("Stock_Coverage_Ratio") >= (cell + 1) * step, F.least(cell + 1, F.lit(points - 1))).when(
        F.col("Stock_Coverage_Ratio") < cell * step, cell - 1
    ).otherwise(cell)
    counts = enriched.groupBy(cell.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole = scalars(enriched, n=F.count(F.lit(1)))["n"]
    grid = enriched.sparkSession.range(points).select(F.col("id").cast("int").alias("step"))
    reach = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counts, "step", "left").select(
        "step", (F.col("step") * step).alias("ratio"),
        (F.sum(F.coalesce("n", F.lit(0))).over(reach) / whole * 100).alias("covered_pct"),
    )


def service_targets(levels: DataFrame, targets: tuple[float, ...] = (95.0, 90.0, 80.0)) -> DataFrame:
    """Coverage ratio whose covered share is nearest to each target, the smallest ratio on ties."""
    each = levels.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    nearest = F.struct(F.abs(F.col("covered_pct") - F.col("target")).alias("gap"), F.col("step"), F.col("ratio"), F.col("covered_pct"))
    best = each.groupBy("target").agg(F.min(nearest).alias("b"))
    return best.select("target", "b.ratio", "b.covered_pct")


LEAD_EDGES = (0.0, 7.0, 14.0, 21.0, 30.0)
LEAD_LABELS = ("1-7d", "8-14d", "15-21d", "22-30d")


def oos_by_lead_time(df: DataFrame) -> DataFrame:
    """Out-of-stock percent per category and lead-time bucket."""
    return (
        df.withColumn("bucket", cut(F.col("Lead_Time_Days"), LEAD_EDGES, LEAD_LABELS))
        .groupBy("Category")
        .pivot("bucket", list(LEAD_LABELS))
        .agg(share(is_out()))
    )


def theoretical_safety_stock(df: DataFrame) -> DataFrame:
    """1.96 x sqrt(mean lead time) x half the daily demand, per SKU with demand."""
    lead = scalars(df, lead=F.avg("Lead_Time_Days"))["lead"]
    return df.where("Daily_Demand_Est > 0").withColumn(
        "Theoretical_Safety", 1.96 * F.sqrt(lead) * F.col("Daily_Demand_Est") * 0.5
    )
