"""Inventory health: enrichment, ABC classes, risk, KPIs, alerts and the tables behind each view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast import constants as K
from shelfcast.functions.numeric import clip, cut, hits, ratio, share
from shelfcast.functions.text import first_word
from shelfcast.operators.scale import global_quantiles, running_totals, scalars, top_rows

def moving() -> Column:
    return F.col("DSI") < K.DSI_SENTINEL


def enrich_base(clean: DataFrame) -> DataFrame:
    """Days of stock, stock coverage and demand intensity."""
    demand, stock, safety = F.col("Daily_Demand_Est"), F.col("Current_Stock"), F.col("Safety_Stock_Target")
    return clean.select(
        "*",
        ratio(stock, demand, K.DSI_SENTINEL).alias("DSI"),
        ratio(stock, safety, 0.0).alias("Stock_Coverage_Ratio"),
        (demand * F.col("Unit_Cost")).alias("Demand_Intensity"),
    )


def with_supply_risk(enriched: DataFrame) -> DataFrame:
    """Weighted risk of long lead time, thin coverage and high demand."""
    top = scalars(enriched, lead=F.max("Lead_Time_Days"), demand=F.max("Daily_Demand_Est"))

    def scale(c: Column) -> Column:
        return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)

    score = (
        F.col("Lead_Time_Days") / scale(top["lead"]) * K.RISK_WEIGHT_LEAD
        + (1 - clip(F.col("Stock_Coverage_Ratio"), 0, 3) / 3) * K.RISK_WEIGHT_COVERAGE
        + F.col("Daily_Demand_Est") / scale(top["demand"]) * K.RISK_WEIGHT_DEMAND
    )
    return enriched.withColumn("Supply_Risk_Score", score)


def abc_label(cumulative: Column) -> Column:
    return F.when(cumulative <= K.ABC_A_PCT, "A").when(cumulative <= K.ABC_B_PCT, "B").otherwise("C")


def with_abc(enriched: DataFrame) -> DataFrame:
    """ABC class by cumulative value share, largest first, ties by Product_ID; one class per row, no self-join."""
    ordered = running_totals(
        enriched,
        [F.col("Inventory_Value").desc_nulls_last(), F.col("Product_ID")],
        {"Cumulative_Value": F.col("Inventory_Value")},
    )
    whole = scalars(enriched, value=F.sum("Inventory_Value"))["value"]
    pct = F.col("Cumulative_Value") / F.greatest(whole, F.lit(1e-9)) * 100
    return ordered.withColumn("Cumulative_Pct", pct).withColumn("ABC_Class", abc_label(pct)).drop("Cumulative_Value")


def with_depletion(enriched: DataFrame) -> DataFrame:
    """Days until empty and the quantity that brings stock back to the reorder point."""
    return enriched.select(
        "*",
        F.col("DSI").alias("Days_to_Deplete"),
        clip(F.col("Reorder_Point") - F.col("Current_Stock"), 0).alias("Suggested_Reorder"),
    )


def health(clean: DataFrame) -> DataFrame:
    """Everything a health view needs: base columns, risk, ABC and depletion."""
    return with_abc(with_depletion(with_supply_risk(enrich_base(clean))))


def kpis(classified: DataFrame) -> DataFrame:
    """KPI row. Slow-moving value counts the sentinel, the mean DSI does not."""
    row = classified.agg(
        F.avg(F.when(moving(), F.col("DSI"))).alias("dsi"),
        F.countDistinct("Product_ID").alias("total_skus"),
        hits(F.col("Stock_Status") == K.STATUS_OUT).alias("oos_count"),
        F.sum(F.when(F.col("DSI") > 90, F.col("Inventory_Value")).otherwise(0.0)).alias("slow_moving_value"),
        F.sum("Inventory_Value").alias("total_inventory_value"),
        *[hits(F.col("ABC_Class") == c).alias(f"abc_{c.lower()}_count") for c in "ABC"],
    )
    return row.select(
        F.when(F.col("dsi") > 0, 365 / F.col("dsi")).otherwise(0.0).alias("inventory_turnover"),
        F.coalesce("dsi", F.lit(0.0)).alias("avg_dsi"),
        ratio(F.col("oos_count") * 100.0, F.col("total_skus"), 0.0).alias("oos_rate"),
        "oos_count", "total_skus", "slow_moving_value", "total_inventory_value",
        "abc_a_count", "abc_b_count", "abc_c_count",
    )


def efficiency_quadrants(classified: DataFrame) -> DataFrame:
    """Quadrant of each moving, valued SKU against the median DSI and the median value."""
    shown = classified.where(moving() & (F.col("Inventory_Value") > 0))
    dsi = global_quantiles(shown, F.col("DSI"), {"m": 0.5})["m"]
    value = global_quantiles(shown, F.col("Inventory_Value"), {"m": 0.5})["m"]
    slow, rich = F.col("DSI") > dsi, F.col("Inventory_Value") > value
    name = (
        F.when(rich & ~slow, "Cash Cow")
        .when(rich & slow, "Dead Stock Risk")
        .when(~rich & ~slow, "Stockout Risk")
        .otherwise("Low Priority")
    )
    return shown.withColumn("Quadrant", name)


def pareto_by(df: DataFrame, key: str) -> DataFrame:
    """Value by key, largest first, with cumulative share and class."""
    sums = df.groupBy(key).agg(F.sum("Inventory_Value").alias("Value"))
    whole = scalars(df, value=F.sum("Inventory_Value"))["value"]
    ordered = running_totals(sums, [F.col("Value").desc_nulls_last(), F.col(key)], {"Running": F.col("Value")})
    pct = F.col("Running") / whole * 100
    return ordered.select(key, "Value", pct.alias("Cumulative_Pct"), abc_label(pct).alias("Class"))


def top_skus(df: DataFrame, n: int = 30) -> DataFrame:
    """The n most valuable SKUs with their cumulative share of all value."""
    whole = scalars(df, value=F.sum("Inventory_Value"))["value"]
    best = top_rows(df, [F.col("Inventory_Value").desc_nulls_last(), F.col("Product_ID")], n)
    running = F.sum("Inventory_Value").over(Window.orderBy("position"))
    return best.withColumn("Cumulative_Share", running / whole * 100)


def stockout_alerts(df: DataFrame, n: int = 20) -> DataFrame:
    """SKUs that run out before a delivery can arrive, most urgent first, padded with SKUs already out."""
    out = F.col("Stock_Status") == K.STATUS_OUT
    soon = (F.col("Days_to_Deplete") < F.col("Lead_Time_Days")) & ~out
    tagged = df.withColumn("Priority", F.when(soon, 1).when(out, 2)).where(F.col("Priority").isNotNull())
    days = F.when(F.col("Priority") == 1, F.col("Days_to_Deplete")).otherwise(0.0)
    return top_rows(tagged, [F.col("Priority"), days, F.col("Product_ID")], n)


def open_alerts(df: DataFrame) -> DataFrame:
    """Every SKU below its lead time or already out."""
    return df.where((F.col("DSI") < F.col("Lead_Time_Days")) | (F.col("Stock_Status") == K.STATUS_OUT))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Stock_Status").agg(F.count(F.lit(1)).alias("skus"))


def vendor_table(df: DataFrame) -> DataFrame:
    """SKU count, value, out-of-stock count and rate per vendor."""
    return df.groupBy("Vendor_Name").agg(
        F.count(F.lit(1)).alias("skus"),
        F.sum("Inventory_Value").alias("value"),
        hits(F.col("Stock_Status") == K.STATUS_OUT).alias("oos"),
        share(F.col("Stock_Status") == K.STATUS_OUT).alias("oos_rate"),
    )


def category_vendor_heat(df: DataFrame) -> DataFrame:
    """Value, stock, lead time and risk per category and vendor, long, so vendors may be any number."""
    return df.groupBy("Category", "Vendor_Name").agg(
        F.sum("Inventory_Value").alias("total_value"),
        F.avg("Current_Stock").alias("avg_stock"),
        F.avg("Lead_Time_Days").alias("avg_lead"),
        F.avg("Supply_Risk_Score").alias("avg_risk"),
    )


def vendor_group_heat(df: DataFrame, categories: list[str], value: str = "Inventory_Value") -> DataFrame:
    """Wide heat table: one row per vendor group (first word of the name), one column per known category, 0 if empty."""
    named = df.withColumn("Vendor_Group", first_word(F.col("Vendor_Name")))
    return named.groupBy("Vendor_Group").pivot("Category", categories).agg(F.sum(value)).fillna(0.0)


def status_shares(df: DataFrame, key: str) -> DataFrame:
    """Percent of SKUs in each status per key."""
    is_ = F.col("Stock_Status")
    return df.groupBy(key).agg(
        share(is_ == K.STATUS_NORMAL).alias("normal_pct"),
        share(is_ == K.STATUS_LOW).alias("low_pct"),
        share(is_ == K.STATUS_OUT).alias("out_pct"),
    )


def category_risk_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("Category").agg(
        share(F.col("Stock_Status") == K.STATUS_NORMAL).alias("normal_pct"),
        share(F.col("Stock_Status") == K.STATUS_LOW).alias("low_pct"),
        share(F.col("Stock_Status") == K.STATUS_OUT).alias("oos_rate"),
        F.avg("Lead_Time_Days").alias("avg_lead"),
        F.sum("Inventory_Value").alias("total_value"),
    )


def risk_levels(df: DataFrame) -> DataFrame:
    """SKU counts per risk level and category; scores outside the bins are left out."""
    level = cut(F.col("Supply_Risk_Score"), K.RISK_BINS, K.RISK_LABELS)
    return df.withColumn("Risk_Level", level).where("Risk_Level is not null").groupBy("Risk_Level", "Category").agg(
        F.count(F.lit(1)).alias("skus")
    )


def risk_quadrants(df: DataFrame) -> DataFrame:
    """SKU counts by demand intensity against its median, coverage against one, and status."""
    shown = df.where((F.col("Stock_Coverage_Ratio") < 10) & (F.col("Demand_Intensity") > 0))
    mid = global_quantiles(shown, F.col("Demand_Intensity"), {"m": 0.5})["m"]
    return shown.groupBy(
        F.when(F.col("Demand_Intensity") > mid, "high demand").otherwise("low demand").alias("demand_side"),
        F.when(F.col("Stock_Coverage_Ratio") < 1, "under covered").otherwise("covered").alias("coverage_side"),
        "Stock_Status",
    ).agg(F.count(F.lit(1)).alias("skus"))
