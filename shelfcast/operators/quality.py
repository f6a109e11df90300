"""Declarative data-quality suites: every rule of a suite is evaluated in one aggregation."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.calendar import strptime_pattern

# Rule suites of the demand and inventory feeds, as (kind, arguments).
DEMAND_SUITE = (
    ("expect_table_columns_to_match_ordered_list", {"column_list": ["date", "product_id", "demand", "price", "category"]}),
    ("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": 10_000_000}),
    ("expect_column_values_to_not_be_null", {"column": "date"}),
    ("expect_column_values_to_not_be_null", {"column": "product_id"}),
    ("expect_column_values_to_not_be_null", {"column": "demand"}),
    ("expect_column_values_to_be_of_type", {"column": "demand", "type_": "float64"}),
    ("expect_column_values_to_be_between", {"column": "demand", "min_value": 0, "max_value": 100_000, "mostly": 0.99}),
    ("expect_column_values_to_be_of_type", {"column": "price", "type_": "float64"}),
    ("expect_column_values_to_be_between", {"column": "price", "min_value": 0.01, "max_value": 50_000, "mostly": 0.99}),
    ("expect_column_values_to_match_strftime_format", {"column": "date", "strftime_format": "%Y-%m-%d"}),
    ("expect_column_values_to_not_be_null", {"column": "product_id"}),
    ("expect_column_distinct_values_to_be_in_set", {"column": "category", "value_set": [
        "Electronics", "Clothing", "Food", "Home", "Sports", "Books", "Toys", "Health", "Automotive", "Garden"]}),
    ("expect_column_mean_to_be_between", {"column": "demand", "min_value": 1, "max_value": 10_000}),
    ("expect_column_stdev_to_be_between", {"column": "demand", "min_value": 0, "max_value": 50_000}),
)
INVENTORY_SUITE = (
    ("expect_table_columns_to_match_set", {"column_set": [
        "date", "product_id", "inventory_level", "warehouse", "reorder_point", "lead_time_days", "unit_cost"], "exact_match": False}),
    ("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": 5_000_000}),
    ("expect_column_values_to_not_be_null", {"column": "product_id"}),
    ("expect_column_values_to_not_be_null", {"column": "inventory_level"}),
    ("expect_column_values_to_not_be_null", {"column": "warehouse"}),
    ("expect_column_values_to_be_of_type", {"column": "inventory_level", "type_": "int64"}),
    ("expect_column_values_to_be_between", {"column": "inventory_level", "min_value": 0, "max_value": 1_000_000}),
    ("expect_column_values_to_be_between", {"column": "lead_time_days", "min_value": 0, "max_value": 365, "mostly": 0.99}),
    ("expect_column_values_to_be_between", {"column": "unit_cost", "min_value": 0.01, "max_value": 100_000, "mostly": 0.99}),
    ("expect_column_values_to_be_between", {"column": "reorder_point", "min_value": 0, "max_value": 500_000}),
    ("expect_column_values_to_match_strftime_format", {"column": "date", "strftime_format": "%Y-%m-%d"}),
    ("expect_column_distinct_values_to_contain_set", {"column": "warehouse", "value_set": ["NYC", "LAX", "CHI"]}),
    ("expect_column_proportion_of_unique_values_to_be_between", {"column": "product_id", "min_value": 0.001, "max_value": 1.0}),
)
# Types that satisfy each expected type.
TYPES = {
    "float64": (T.DoubleType, T.FloatType, T.LongType, T.IntegerType),
    "int64": (T.LongType, T.IntegerType),
    "object": (T.StringType,),
}


def load_suite(path: str) -> tuple[tuple[str, dict[str, Any]], ...]:
    """Suite from a JSON file with a list of expectations."""
    with open(path, encoding="utf-8") as f:
        return tuple((e.get("expectation_type", ""), e.get("kwargs", {})) for e in json.load(f)["expectations"])


def _rule(df: DataFrame, kind: str, a: dict[str, Any]) -> tuple[Column, Column]:
    """(passed, observed value) of one rule as aggregate expressions."""
    no_value = F.lit(None).cast("double")
    column = a.get("column")
    if kind == "expect_table_columns_to_match_ordered_list":
        return F.lit(df.columns == list(a.get("column_list", []))), no_value
    if kind == "expect_table_columns_to_match_set":
        want, have = set(a.get("column_set", [])), set(df.columns)
        return F.lit(have == want if a.get("exact_match", True) else want <= have), no_value
    rows = F.count(F.lit(1))
    if kind == "expect_table_row_count_to_be_between":
        return rows.between(a["min_value"], a["max_value"]), rows.cast("double")
    if not kind.startswith("expect_column_"):
        return F.lit(True), no_value
    if column not in df.columns:
        return F.lit(False), no_value
    c = F.col(f"`{column}`")

    if kind == "expect_column_values_to_not_be_null":
        missing = F.count(F.when(c.isNull(), 1))
        return missing == 0, missing.cast("double")
    if kind == "expect_column_values_to_be_between":
        ok = F.coalesce(c.between(a["min_value"], a["max_value"]), F.lit(False))
        part = F.avg(F.when(ok, 1.0).otherwise(0.0))
        return F.coalesce(part >= a.get("mostly", 1.0), F.lit(False)), part
    if kind == "expect_column_values_to_be_of_type":
        return F.lit(isinstance(df.schema[column].dataType, TYPES.get(a["type_"], ()))), no_value
    if kind == "expect_column_values_to_be_unique":
        extra = rows - F.countDistinct(c) - F.when(F.count(F.when(c.isNull(), 1)) > 0, 1).otherwise(0)
        return extra == 0, extra.cast("double")
    if kind == "expect_column_values_to_match_strftime_format":
        fmt = strptime_pattern(a.get("strftime_format", "%Y-%m-%d"))
        wrong = F.count(F.when(c.isNotNull() & F.try_to_timestamp(c.cast("string"), F.lit(fmt)).isNull(), 1))
        return wrong == 0, wrong.cast("double")
    if kind == "expect_column_distinct_values_to_be_in_set":
        wrong = F.count(F.when(c.isNotNull() & ~c.isin(a.get("value_set", [])), 1))
        return wrong == 0, wrong.cast("double")
    if kind == "expect_column_distinct_values_to_contain_set":
        found = [F.max(F.when(c == v, 1).otherwise(0)) for v in a.get("value_set", [])]
        total = sum((F.coalesce(f, F.lit(0)) for f in found), F.lit(0))
        return total == len(found), total.cast("double")
    if kind == "expect_column_mean_to_be_between":
        return F.coalesce(F.avg(c).between(a["min_value"], a["max_value"]), F.lit(False)), F.avg(c)
    if kind == "expect_column_stdev_to_be_between":
        return F.coalesce(F.stddev_samp(c).between(a["min_value"], a["max_value"]), F.lit(False)), F.stddev_samp(c)
    if kind == "expect_column_proportion_of_unique_values_to_be_between":
        part = F.when(rows > 0, F.countDistinct(c) / rows).otherwise(0.0)
        return part.between(a["min_value"], a["max_value"]), part
    return F.lit(True), no_value


def run_suite(df: DataFrame, suite) -> DataFrame:
    """One row per rule: number, kind, column, passed, observed."""
    cells = []
    for i, (kind, a) in enumerate(suite):
        try:
            passed, observed = _rule(df, kind, a)
        except (KeyError, TypeError):
            passed, observed = F.lit(False), F.lit(None).cast("double")
        cells.append(F.struct(
            F.lit(i).alias("rule"), F.lit(kind).alias("expectation"), F.lit(a.get("column")).cast("string").alias("column"),
            passed.alias("passed"), observed.alias("observed"),
        ))
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def suite_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.count(F.when(~F.col("passed"), 1)).alias("failed"), F.bool_and("passed").alias("success"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def write_report(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
