"""Feeds derived from the star-schema tables: dirty inventory, daily demand, signals, request log, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.constants import STAGES
from shelfcast.functions.calendar import retail_holiday


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship_day(col: Column) -> Column:
    return F.to_date(col)


def raw_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One dirty row per part, as an inventory export would send it.

    Line items are first reduced to (part, day), which bounds a hot part by the calendar, then to one row per part.
    """
    lines = table(spark, folder, "lineitem")
    daily = lines.groupBy("l_partkey", ship_day(F.col("l_shipdate")).alias("day")).agg(
        F.sum("l_quantity").alias("qty"),
        F.max("l_suppkey").alias("suppkey"),
    )
    sales = daily.groupBy("l_partkey").agg(
        (F.sum("qty") / F.count("day")).alias("per_day"),
        F.max_by("suppkey", "day").alias("suppkey"),  # the supplier of the last day
    )
    vendors = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name")
    parts = table(spark, folder, "part").join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
    joined = parts.join(vendors, "suppkey", "left")

    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(14,2)").cast("string")
    text_id = F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0"))
    return joined.select(
        key.alias("part_key"),
        F.when(key % 7 == 0, F.concat(F.lit("  "), text_id, F.lit("\t"))).otherwise(text_id).alias("Product_ID"),
        F.when(key % 3 == 0, F.lower("p_type"))
        .when(key % 3 == 1, F.concat(F.lit(" "), F.col("p_type")))
        .otherwise(F.initcap("p_type"))
        .alias("Category"),
        F.when(key % 11 == 1, F.concat(F.lit("$"), price))
        .when(key % 11 == 2, F.concat(F.lit("USD "), price))
        .when(key % 41 == 0, "N/A")
        .when(key % 43 == 0, F.lit(None))
        .when(key % 47 == 0, "1.2.3")
        .otherwise(price)
        .alias("Unit_Cost_Raw"),
        F.when(key % 13 == 0, "0")
        .when(key % 17 == 0, "-5")
        .when(key % 19 == 0, "abc")
        .when(key % 23 == 0, F.lit(None))
        .otherwise(((key * 37) % 2000).cast("string"))
        .alias("Current_Stock_Raw"),
        F.when(key % 29 == 0, -1.0).when(key % 53 == 0, 0.0).otherwise(F.col("per_day")).alias("Daily_Demand_Est"),
        F.when(key % 31 == 0, 0.0)
        .when(key % 37 == 0, -10.0)
        .otherwise(F.col("p_size") * 5.0)
        .alias("Safety_Stock_Target"),
        F.when(key % 5 == 0, F.concat(F.lit(" "), F.col("s_name"), F.lit("  "))).otherwise(F.col("s_name")).alias("Vendor_Name"),
        (F.col("p_size") % 31).cast("double").alias("Lead_Time_Days"),
    )


def brand_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Dense daily demand: one series per brand."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", ship_day(F.col("l_shipdate")).alias("ds"))
    daily = lines.groupBy("l_partkey", "ds").agg(F.sum("l_quantity").alias("y"))
    brands = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unique_id"))
    return daily.join(brands, "l_partkey").groupBy("unique_id", "ds").agg(F.sum("y").alias("y"))


def sku_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the hierarchy attributes of their region, type and brand."""
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", ship_day(F.col("l_shipdate")).alias("ds")
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    )
    joined = lines.join(parts, "l_partkey").join(places, "l_suppkey")
    group = F.concat(F.col("p_type"), F.lit("-"), (F.regexp_replace("p_brand", "[^0-9]", "").cast("int") % 5).cast("string"))
    return joined.select(
        F.concat_ws("|", "r_name", "p_type", "p_brand").alias("unique_id"),
        F.col("r_name").alias("warehouse"),
        F.col("p_type").alias("category"),
        group.alias("subcategory"),
        "ds", "l_quantity", "l_extendedprice", "l_discount",
    )


def sku_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily facts per sparse series: demand, mean unit price and mean discount, with hierarchy columns."""
    return sku_lines(spark, folder).groupBy("unique_id", "warehouse", "category", "subcategory", "ds").agg(
        F.sum("l_quantity").alias("y"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.avg("l_discount").alias("discount"),
    )


def demand_of(facts: DataFrame) -> DataFrame:
    return facts.select("unique_id", "ds", "y")


def static_of(facts: DataFrame) -> DataFrame:
    return facts.select("unique_id", "warehouse", "category", "subcategory").distinct()


def future_drivers(facts: DataFrame) -> DataFrame:
    """Known-ahead drivers: promotion flag, holiday flag and a seasonal temperature proxy."""
    return facts.select(
        "unique_id", "ds",
        (F.round("discount", 6) > 0.05).cast("int").alias("promo_flag"),
        retail_holiday(F.col("ds")).alias("is_holiday"),
        (15.0 + 10.0 * F.sin(2 * F.lit(3.141592653589793) * F.dayofyear("ds") / 365.0)).alias("temperature"),
    )


def past_drivers(facts: DataFrame) -> DataFrame:
    """Observed drivers: price and a stock level that runs out when a day's demand is a multiple of seven."""
    return facts.select(
        "unique_id", "ds", "price",
        F.when(F.col("y") % 7 == 0, 0.0).otherwise(F.col("y") * 2).alias("stock_level"),
    )


def calendar_spine(demand: DataFrame) -> DataFrame:
    """Fill the days a series skips with zero demand, between its own first and last day."""
    spans = demand.groupBy("unique_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    days = spans.select("unique_id", F.explode(F.sequence("a", "b")).alias("ds"))
    return days.join(demand, ["unique_id", "ds"], "left").select("unique_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


def signal_columns(events: DataFrame) -> DataFrame:
    """Event log as demand signals, without a day number; works on tables and on streams."""
    source = (
        F.when(F.col("event_type") == "purchase", "pos")
        .when(F.col("event_type") == "click", "social")
        .when(F.col("event_type") == "view", "weather")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        "event_id",
        source.alias("source"),
        F.concat(F.lit("SKU-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("product_id"),
        F.col("value").alias("signal_value"),
        (0.6 + (F.col("event_id") % 41) / 100.0).alias("confidence"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def demand_signals(spark: SparkSession, folder: str) -> DataFrame:
    """External demand signals from the event log; the day number counts from the first event day."""
    events = table(spark, folder, "events")
    first = events.agg(F.to_date(F.min("ts"))).scalar()
    day = F.concat(F.lit("day_"), F.date_diff(F.to_date("ts"), first).cast("string"))
    return signal_columns(events).withColumn("timestamp", F.when(F.col("event_id") % 97 == 0, "unknown").otherwise(day))


def log_columns(events: DataFrame) -> DataFrame:
    """Event log as audit events: who called what, with which status and how long it took."""
    kind = F.col("event_type")
    status = (
        F.when((kind == "error") & (F.col("event_id") % 3 == 0), 503)
        .when(kind == "error", 404)
        .when(kind == "signup", 201)
        .otherwise(200)
    )
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(kind == "view", "GET").when(kind == "purchase", "PUT").otherwise("POST").alias("action"),
        F.concat(F.lit("/api/"), kind, F.lit("/"), (F.col("event_id") % 10).cast("string")).alias("resource"),
        status.cast("int").alias("status_code"),
        (F.col("value") * 4).alias("duration_ms"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return log_columns(table(spark, folder, "events"))


def stage_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run table: one batch per order."""
    orders = table(spark, folder, "orders")
    started = F.col("o_orderdate").cast("timestamp")
    done = F.when(
        F.col("o_orderstatus") != "O", F.timestamp_seconds(F.unix_timestamp(started) + 60 + F.col("o_orderkey") % 7200)
    )
    return orders.select(
        F.concat(F.lit("batch_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("batch_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.concat(F.lit("feed_"), F.col("o_custkey").cast("string"), F.lit("_dirty.csv")).alias("source_file"),
        started.alias("started_at"),
        done.alias("completed_at"),
        F.when(F.col("o_orderstatus") == "P", "stage failed").alias("error_message"),
    )


def stage_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result table: one analysis per (order, line number), stage chosen by the line number."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("units"), F.sum("l_extendedprice").alias("value")
    )
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("l_linenumber"))
    return lines.select(
        F.concat(F.lit("batch_"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("batch_id"),
        stage.alias("analysis_type"),
        F.to_json(F.struct(F.col("units").cast("long").alias("units"), F.round("value", 2).cast("decimal(18,2)").cast("string").alias("value"))).alias("result_json"),
        F.col("l_linenumber").alias("position"),
    )
