"""Cleaning of dirty inventory feeds: eight steps as one lazy projection, plus its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.constants import STATUS_LOW, STATUS_NORMAL, STATUS_OUT
from shelfcast.functions.numeric import clip, hits
from shelfcast.functions.text import capitalise, money, number, squeeze_ends
from shelfcast.operators.scale import attach, exact_quantiles, global_quantiles
from shelfcast.session import pin

RAW_COLUMNS = (
    "Product_ID", "Category", "Unit_Cost_Raw", "Current_Stock_Raw",
    "Daily_Demand_Est", "Safety_Stock_Target", "Vendor_Name", "Lead_Time_Days",
)
CLEAN_COLUMNS = (
    "Product_ID", "Category", "Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Safety_Stock_Target",
    "Vendor_Name", "Lead_Time_Days", "Reorder_Point", "Stock_Status", "Inventory_Value",
)


def parse_feed(raw: DataFrame) -> DataFrame:
    """Text and number parsing only, with the unparsed columns kept for counting."""
    return raw.select(
        *[c for c in raw.columns if c not in RAW_COLUMNS],
        squeeze_ends(F.col("Product_ID")).alias("Product_ID"),
        F.col("Category").alias("Category_Raw"),
        capitalise(squeeze_ends(F.col("Category"))).alias("Category"),
        money(F.col("Unit_Cost_Raw")).alias("Parsed_Cost"),
        number(F.col("Current_Stock_Raw")).alias("Parsed_Stock"),
        F.col("Daily_Demand_Est").cast("double").alias("Daily_Demand_Est"),
        F.col("Safety_Stock_Target").cast("double").alias("Safety_Stock_Target"),
        squeeze_ends(F.col("Vendor_Name")).alias("Vendor_Name"),
        F.col("Lead_Time_Days").cast("double").alias("Parsed_Lead"),
    )


def fill_costs(parsed: DataFrame) -> DataFrame:
    """Missing cost: median of its category, then median of the column after that first fill.

    The first fill is pinned, so the second median reads one stored column instead of parsing the feed again.
    """
    per_category = exact_quantiles(parsed, F.col("Parsed_Cost"), {"Category_Median": 0.5}, by=["Category"])
    filled = attach(parsed, per_category, ["Category"]).withColumn(
        "Unit_Cost", F.coalesce("Parsed_Cost", "Category_Median")
    )
    first = pin(filled.drop("Category_Median"), "costs")
    overall = global_quantiles(first, F.col("Unit_Cost"), {"m": 0.5})["m"]
    return first.withColumn("Unit_Cost", F.coalesce("Unit_Cost", overall))


def derive_fields(filled: DataFrame) -> DataFrame:
    """Ranges, reorder point, status and value. A comparison with null counts as false, so it ends as normal."""
    ranged = (
        filled.withColumn("Current_Stock", F.coalesce(clip(F.col("Parsed_Stock"), 0), F.lit(0.0)))
        .withColumn("Daily_Demand_Est", clip(F.col("Daily_Demand_Est"), 0))
        .withColumn("Safety_Stock_Target", clip(F.col("Safety_Stock_Target"), 0))
        .withColumn("Lead_Time_Days", clip(F.col("Parsed_Lead"), 1))
    )
    point = F.col("Daily_Demand_Est") * F.col("Lead_Time_Days") + F.col("Safety_Stock_Target")
    status = (
        F.when(F.col("Current_Stock") == 0, STATUS_OUT)
        .when(F.col("Current_Stock") < F.col("Reorder_Point"), STATUS_LOW)
        .otherwise(STATUS_NORMAL)
    )
    return (
        ranged.withColumn("Reorder_Point", point)
        .withColumn("Stock_Status", status)
        .withColumn("Inventory_Value", F.col("Current_Stock") * F.col("Unit_Cost"))
    )


def prepare(raw: DataFrame) -> DataFrame:
    """All steps, with the parsed columns still present (the counters need them)."""
    return derive_fields(fill_costs(parse_feed(raw)))


def clean_inventory(raw: DataFrame) -> DataFrame:
    """Dirty feed to the eleven clean columns."""
    return prepare(raw).select(*CLEAN_COLUMNS)


def feed_counters(prepared: DataFrame) -> DataFrame:
    """Every counter of a cleaning run in one aggregation."""
    return prepared.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.countDistinct("Category_Raw").alias("categories_before"),
        F.countDistinct("Category").alias("categories_after"),
        hits(F.col("Parsed_Cost").isNull()).alias("invalid_costs"),
        hits(F.col("Parsed_Stock") < 0).alias("negative_stocks"),
        hits(F.col("Parsed_Stock").isNull()).alias("null_stocks_filled"),
        hits(F.col("Parsed_Cost").isNull()).alias("null_costs_filled"),
        hits(F.col("Parsed_Lead") < 1).alias("bad_lead_times"),
        hits(F.col("Stock_Status") == STATUS_OUT).alias("out_of_stock"),
        hits(F.col("Stock_Status") == STATUS_LOW).alias("low_stock"),
        hits(F.col("Stock_Status") == STATUS_NORMAL).alias("normal_stock"),
        F.sum("Inventory_Value").alias("total_inventory_value"),
    )
