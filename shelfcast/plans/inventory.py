"""Registered queries: cleaning, inventory health and supply chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.numeric import tidy
from shelfcast.operators import etl, inventory, supply
from shelfcast.operators import statistics as stats
from shelfcast.operators.scale import exact_quantiles
from shelfcast.plans import base
from shelfcast.plans.base import CLEAN, ENRICHED, HEALTH, PARSED, SUPPLY, VALID, Query, sql

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df, keep=(), digits=4, **cols):
    """Select ``keep`` plus rounded numbers: name=source column."""
    return df.select(*keep, *[tidy(F.col(c) if isinstance(c, str) else c, digits).alias(n) for n, c in cols.items()])


def same(*names):
    return {n: n for n in names}


def rsql(*names, digits=4):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


NUMS = ("Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Safety_Stock_Target", "Lead_Time_Days", "Reorder_Point", "Inventory_Value")
TEXTS = ("Product_ID", "Category", "Vendor_Name", "Stock_Status")


@register("etl_clean", sql(CLEAN, f"SELECT {', '.join(TEXTS)}, {rsql(*NUMS)} FROM clean"))
def _(spark, folder):
    return rounded(etl.clean_inventory(base.raw(spark, folder)), TEXTS, **same(*NUMS))


@register("etl_counters", sql(PARSED, """
SELECT count(*) AS raw_rows, count(DISTINCT Category_Raw) AS categories_before, count(DISTINCT Category) AS categories_after,
  count(*) FILTER (Parsed_Cost IS NULL) AS invalid_costs, count(*) FILTER (Parsed_Stock < 0) AS negative_stocks,
  count(*) FILTER (Parsed_Stock IS NULL) AS null_stocks_filled, count(*) FILTER (Parsed_Cost IS NULL) AS null_costs_filled,
  count(*) FILTER (Parsed_Lead < 1) AS bad_lead_times, count(*) FILTER (Stock_Status = 'Out of Stock') AS out_of_stock,
  count(*) FILTER (Stock_Status = 'Low Stock') AS low_stock, count(*) FILTER (Stock_Status = 'Normal Stock') AS normal_stock,
  round(sum(Inventory_Value), 2) AS total_inventory_value FROM prepared"""))
def _(spark, folder):
    row = etl.feed_counters(base.prepared(spark, folder))
    return row.withColumn("total_inventory_value", F.round("total_inventory_value", 2))


@register("etl_parse_costs", sql(PARSED, "SELECT Product_ID, Parsed_Cost AS parsed_cost, Parsed_Stock AS parsed_stock FROM parsed"))
def _(spark, folder):
    return etl.parse_feed(base.raw(spark, folder)).select(
        "Product_ID", F.col("Parsed_Cost").alias("parsed_cost"), F.col("Parsed_Stock").alias("parsed_stock")
    )


@register("category_normalisation", sql(PARSED, "SELECT Category_Raw AS raw_category, Category AS category, count(*) AS n FROM parsed GROUP BY 1, 2"))
def _(spark, folder):
    return etl.parse_feed(base.raw(spark, folder)).groupBy(
        F.col("Category_Raw").alias("raw_category"), F.col("Category").alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))


@register("inventory_enriched", sql(ENRICHED, f"SELECT Product_ID, {rsql('DSI', 'Stock_Coverage_Ratio', 'Demand_Intensity', digits=6)} FROM enriched"))
def _(spark, folder):
    return rounded(base.enriched(spark, folder), ["Product_ID"], 6, **same("DSI", "Stock_Coverage_Ratio", "Demand_Intensity"))


@register("supply_risk", sql(HEALTH, f"SELECT Product_ID, {rsql('Supply_Risk_Score')} FROM health"))
def _(spark, folder):
    return rounded(inventory.with_supply_risk(base.enriched(spark, folder)), ["Product_ID"], **same("Supply_Risk_Score"))


@register("abc_classes", sql(HEALTH, f"SELECT Product_ID, ABC_Class, {rsql('Inventory_Value', 'Cumulative_Pct')} FROM health"))
def _(spark, folder):
    return rounded(inventory.with_abc(base.enriched(spark, folder)), ["Product_ID", "ABC_Class"], **same("Inventory_Value", "Cumulative_Pct"))


@register("depletion", sql(HEALTH, f"SELECT Product_ID, {rsql('Days_to_Deplete', 'Suggested_Reorder')} FROM health"))
def _(spark, folder):
    return rounded(inventory.with_depletion(base.enriched(spark, folder)), ["Product_ID"], **same("Days_to_Deplete", "Suggested_Reorder"))


@register("inventory_kpis", sql(HEALTH, """
SELECT round(365 / d, 4) AS inventory_turnover, round(d, 4) AS avg_dsi, round(oos_count * 100.0 / total_skus, 4) AS oos_rate,
  oos_count, total_skus, round(slow, 2) AS slow_moving_value, round(total, 2) AS total_inventory_value,
  a AS abc_a_count, b AS abc_b_count, c AS abc_c_count
FROM (SELECT avg(DSI) FILTER (DSI < 999) AS d, count(DISTINCT Product_ID) AS total_skus,
  count(*) FILTER (Stock_Status = 'Out of Stock') AS oos_count, sum(Inventory_Value) FILTER (DSI > 90) AS slow,
  sum(Inventory_Value) AS total, count(*) FILTER (ABC_Class = 'A') AS a, count(*) FILTER (ABC_Class = 'B') AS b,
  count(*) FILTER (ABC_Class = 'C') AS c FROM health)"""))
def _(spark, folder):
    row = inventory.kpis(base.classified(spark, folder))
    for c in ("inventory_turnover", "avg_dsi", "oos_rate"):
        row = row.withColumn(c, F.round(c, 4))
    for c in ("slow_moving_value", "total_inventory_value"):
        row = row.withColumn(c, F.round(c, 2))
    return row


@register("efficiency_quadrants", sql(HEALTH, """,
shown AS (SELECT * FROM health WHERE DSI < 999 AND Inventory_Value > 0),
mid AS (SELECT quantile_cont(DSI, 0.5) AS d, quantile_cont(Inventory_Value, 0.5) AS v FROM shown)
SELECT CASE WHEN Inventory_Value > v AND DSI <= d THEN 'Cash Cow' WHEN Inventory_Value > v THEN 'Dead Stock Risk'
  WHEN DSI <= d THEN 'Stockout Risk' ELSE 'Low Priority' END AS Quadrant, ABC_Class, count(*) AS skus
FROM shown, mid GROUP BY 1, 2"""))
def _(spark, folder):
    return inventory.efficiency_quadrants(base.classified(spark, folder)).groupBy("Quadrant", "ABC_Class").agg(
        F.count(F.lit(1)).alias("skus")
    )


@register("pareto_categories", sql(HEALTH, """,
c AS (SELECT Category, sum(Inventory_Value) AS v FROM health GROUP BY 1),
r AS (SELECT Category, v, sum(v) OVER (ORDER BY v DESC, Category ROWS UNBOUNDED PRECEDING) / (SELECT sum(v) FROM c) * 100 AS p FROM c)
SELECT Category, round(v, 2) AS Value, round(p, 4) AS Cumulative_Pct,
  CASE WHEN p <= 80 THEN 'A' WHEN p <= 95 THEN 'B' ELSE 'C' END AS Class FROM r"""))
def _(spark, folder):
    out = inventory.pareto_by(base.clean(spark, folder), "Category")
    return out.select("Category", F.round("Value", 2).alias("Value"), F.round("Cumulative_Pct", 4).alias("Cumulative_Pct"), "Class")


@register("top_skus", sql(HEALTH, """
SELECT Product_ID, ABC_Class, position, round(Inventory_Value, 2) AS Inventory_Value,
  round(sum(Inventory_Value) OVER (ORDER BY position) / (SELECT sum(Inventory_Value) FROM health) * 100, 4) AS Cumulative_Share
FROM (SELECT *, row_number() OVER (ORDER BY Inventory_Value DESC NULLS LAST, Product_ID) AS position FROM health)
WHERE position <= 30"""))
def _(spark, folder):
    out = inventory.top_skus(base.classified(spark, folder))
    return out.select(
        "Product_ID", "ABC_Class", "position", F.round("Inventory_Value", 2).alias("Inventory_Value"),
        F.round("Cumulative_Share", 4).alias("Cumulative_Share"),
    )


@register("stockout_alerts", sql(HEALTH, """
SELECT Product_ID, Stock_Status, pos AS position, round(Suggested_Reorder, 4) AS Suggested_Reorder FROM (
  SELECT *, row_number() OVER (ORDER BY pr, CASE WHEN pr = 1 THEN Days_to_Deplete ELSE 0 END, Product_ID) AS pos FROM (
    SELECT *, CASE WHEN Days_to_Deplete < Lead_Time_Days AND Stock_Status <> 'Out of Stock' THEN 1
      WHEN Stock_Status = 'Out of Stock' THEN 2 END AS pr FROM health) WHERE pr IS NOT NULL) WHERE pos <= 20"""))
def _(spark, folder):
    out = inventory.stockout_alerts(base.classified(spark, folder))
    return out.select("Product_ID", "Stock_Status", "position", F.round("Suggested_Reorder", 4).alias("Suggested_Reorder"))


@register("open_alerts", sql(HEALTH, """SELECT Product_ID, Stock_Status, round(DSI, 4) AS DSI FROM health
WHERE DSI < Lead_Time_Days OR Stock_Status = 'Out of Stock'"""))
def _(spark, folder):
    return rounded(inventory.open_alerts(base.enriched(spark, folder)), ["Product_ID", "Stock_Status"], **same("DSI"))


@register("status_counts", sql(CLEAN, "SELECT Stock_Status, count(*) AS skus FROM clean GROUP BY 1"))
def _(spark, folder):
    return inventory.status_counts(base.clean(spark, folder))


@register("vendor_table", sql(CLEAN, """SELECT Vendor_Name, count(*) AS skus, round(sum(Inventory_Value), 2) AS value,
count(*) FILTER (Stock_Status = 'Out of Stock') AS oos,
round(avg(CASE WHEN Stock_Status = 'Out of Stock' THEN 1.0 ELSE 0.0 END) * 100, 4) AS oos_rate FROM clean GROUP BY 1"""))
def _(spark, folder):
    return inventory.vendor_table(base.clean(spark, folder)).withColumn("value", F.round("value", 2)).withColumn("oos_rate", F.round("oos_rate", 4))


@register("category_vendor_heat", sql(HEALTH, """SELECT Category, Vendor_Name, round(sum(Inventory_Value), 2) AS total_value,
round(avg(Current_Stock), 4) AS avg_stock, round(avg(Lead_Time_Days), 4) AS avg_lead, round(avg(Supply_Risk_Score), 4) AS avg_risk
FROM health GROUP BY 1, 2"""))
def _(spark, folder):
    out = inventory.category_vendor_heat(base.classified(spark, folder))
    return rounded(out, ["Category", "Vendor_Name", F.round("total_value", 2).alias("total_value")], **same("avg_stock", "avg_lead", "avg_risk"))


# The part types of the data model, after case normalisation.
CATEGORIES = ["Economy", "Large", "Medium", "Promo", "Small", "Standard"]


@register("vendor_category_pivot", sql(CLEAN, "SELECT split_part(Vendor_Name, ' ', 1) AS Vendor_Group, " + ", ".join(
    f"round(coalesce(sum(Inventory_Value) FILTER (Category = '{c}'), 0), 2) AS \"{c}\"" for c in CATEGORIES) + " FROM clean GROUP BY 1"))
def _(spark, folder):
    out = inventory.vendor_group_heat(base.clean(spark, folder), CATEGORIES)
    return out.select("Vendor_Group", *[F.round(c, 2).alias(c) for c in CATEGORIES])


def pct_sql(status):
    return f"round(avg(CASE WHEN Stock_Status = '{status}' THEN 1.0 ELSE 0.0 END) * 100, 4)"


SHARES = f"{pct_sql('Normal Stock')} AS normal_pct, {pct_sql('Low Stock')} AS low_pct"


@register("category_risk_profile", sql(CLEAN, f"""SELECT Category, {SHARES}, {pct_sql('Out of Stock')} AS oos_rate,
round(avg(Lead_Time_Days), 4) AS avg_lead, round(sum(Inventory_Value), 2) AS total_value FROM clean GROUP BY 1"""))
def _(spark, folder):
    out = inventory.category_risk_profile(base.clean(spark, folder))
    return rounded(out, ["Category", F.round("total_value", 2).alias("total_value")], **same("normal_pct", "low_pct", "oos_rate", "avg_lead"))


@register("vendor_status_shares", sql(CLEAN, f"SELECT Vendor_Name, {SHARES}, {pct_sql('Out of Stock')} AS out_pct FROM clean GROUP BY 1"))
def _(spark, folder):
    return rounded(inventory.status_shares(base.clean(spark, folder), "Vendor_Name"), ["Vendor_Name"], **same("normal_pct", "low_pct", "out_pct"))


@register("risk_levels", sql(HEALTH, """SELECT CASE WHEN s <= 0.3 THEN 'Low' WHEN s <= 0.5 THEN 'Medium' WHEN s <= 0.7 THEN 'High'
ELSE 'Critical' END AS Risk_Level, Category, count(*) AS skus
FROM (SELECT Supply_Risk_Score AS s, Category FROM health) WHERE s > 0 AND s <= 1 GROUP BY 1, 2"""))
def _(spark, folder):
    return inventory.risk_levels(base.classified(spark, folder))


@register("risk_quadrants", sql(ENRICHED, """,
shown AS (SELECT * FROM enriched WHERE Stock_Coverage_Ratio < 10 AND Demand_Intensity > 0)
SELECT CASE WHEN Demand_Intensity > (SELECT quantile_cont(Demand_Intensity, 0.5) FROM shown) THEN 'high demand' ELSE 'low demand' END AS demand_side,
  CASE WHEN Stock_Coverage_Ratio < 1 THEN 'under covered' ELSE 'covered' END AS coverage_side, Stock_Status, count(*) AS skus
FROM shown GROUP BY 1, 2, 3"""))
def _(spark, folder):
    return inventory.risk_quadrants(base.enriched(spark, folder))


@register("cost_histogram", sql(CLEAN, """, e AS (SELECT min(Unit_Cost) AS lo, max(Unit_Cost) AS hi, count(Unit_Cost) AS n FROM clean)
SELECT bin, round(lo + bin * (hi - lo) / 10, 4) AS low, count(*) AS n FROM (
SELECT least(floor((Unit_Cost - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, lo, hi FROM clean, e) GROUP BY bin, lo, hi"""))
def _(spark, folder):
    return rounded(stats.histogram(base.clean(spark, folder), F.col("Unit_Cost"), 10), ["bin", "n"], **same("low"))


@register("vendor_five_numbers", sql(CLEAN, """,
o AS (SELECT Vendor_Name, Inventory_Value AS v, row_number() OVER (PARTITION BY Vendor_Name ORDER BY Inventory_Value) - 1 AS i,
  count(*) OVER (PARTITION BY Vendor_Name) AS n FROM clean WHERE Vendor_Name IS NOT NULL AND Inventory_Value IS NOT NULL)
SELECT Vendor_Name, round(min(v), 4) AS low, round(max(v) FILTER (i = floor(n * 0.25)), 4) AS q1, round(max(v) FILTER (i = floor(n * 0.5)), 4) AS median,
  round(max(v) FILTER (i = floor(n * 0.75)), 4) AS q3, round(max(v), 4) AS high, round(avg(v), 6) AS mean FROM o GROUP BY 1"""))
def _(spark, folder):
    out = stats.five_numbers(base.clean(spark, folder), "Vendor_Name", "Inventory_Value")
    return rounded(out, ["Vendor_Name", F.round("mean", 6).alias("mean")], **same("low", "q1", "median", "q3", "high"))


@register("category_quantiles", sql(CLEAN, """SELECT Category, round(quantile_cont(Unit_Cost, 0.25), 4) AS q1, round(quantile_cont(Unit_Cost, 0.5), 4) AS median,
round(quantile_cont(Unit_Cost, 0.75), 4) AS q3 FROM clean GROUP BY 1"""))
def _(spark, folder):
    out = exact_quantiles(base.clean(spark, folder), F.col("Unit_Cost"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["Category"])
    return rounded(out, ["Category"], **same("q1", "median", "q3"))


@register("inventory_page", sql(CLEAN, """SELECT Product_ID, Category, round(Unit_Cost, 4) AS Unit_Cost FROM clean
ORDER BY Unit_Cost DESC NULLS LAST, Product_ID LIMIT 100 OFFSET 100"""))
def _(spark, folder):
    page = base.clean(spark, folder).orderBy(F.col("Unit_Cost").desc_nulls_last(), "Product_ID").offset(100).limit(100)
    return rounded(page, ["Product_ID", "Category"], **same("Unit_Cost"))


@register("status_sample", sql(CLEAN, """SELECT Product_ID, Stock_Status FROM clean WHERE Unit_Cost IS NOT NULL AND Current_Stock IS NOT NULL
AND Daily_Demand_Est IS NOT NULL AND Lead_Time_Days IS NOT NULL AND Inventory_Value IS NOT NULL
ORDER BY md5('42|' || Product_ID), Product_ID LIMIT 500"""))
def _(spark, folder):
    shown = base.clean(spark, folder).dropna(subset=["Unit_Cost", "Current_Stock", "Daily_Demand_Est", "Lead_Time_Days", "Inventory_Value"])
    return stats.hash_sample(shown, "Product_ID", 500).select("Product_ID", "Stock_Status")


# ---- supply chain ----------------------------------------------------------------------------------------------

SUPPLY_COLUMNS = ("Annual_Demand", "Reorder_Gap", "Holding_Cost", "EOQ", "Annual_Orders", "Total_Inventory_Cost")


@register("order_quantities", sql(SUPPLY, f"SELECT Product_ID, {rsql(*SUPPLY_COLUMNS)} FROM supply"))
def _(spark, folder):
    return rounded(base.supply(spark, folder), ["Product_ID"], **same(*SUPPLY_COLUMNS))


@register("valid_order_quantities", sql(VALID, "SELECT Product_ID, round(EOQ, 4) AS EOQ FROM valid"))
def _(spark, folder):
    return rounded(base.valid_orders(spark, folder), ["Product_ID"], **same("EOQ"))


@register("eoq_by_category", sql(VALID, """SELECT Category, count(*) AS skus, round(min(EOQ), 4) AS low, round(quantile_cont(EOQ, 0.25), 4) AS q1,
round(quantile_cont(EOQ, 0.5), 4) AS median, round(quantile_cont(EOQ, 0.75), 4) AS q3, round(max(EOQ), 4) AS high FROM valid GROUP BY 1"""))
def _(spark, folder):
    out = supply.eoq_by_category(base.valid_orders(spark, folder))
    return rounded(out, ["Category", "skus"], **same("low", "q1", "median", "q3", "high"))


@register("eoq_curve", sql(VALID, """, t AS (SELECT max(Annual_Demand) AS top, quantile_cont(Holding_Cost, 0.5) AS h FROM valid)
SELECT i::INTEGER AS step, round(1 + i * (top - 1) / 199, 4) AS annual_demand, round(sqrt(2 * (1 + i * (top - 1) / 199) * 50 / h), 4) AS eoq
FROM t, range(200) r(i)"""))
def _(spark, folder):
    return rounded(supply.eoq_curve(base.valid_orders(spark, folder)), ["step"], **same("annual_demand", "eoq"))


@register("order_cost_breakdown", sql(VALID, """SELECT Category, round(sum(EOQ / 2 * Holding_Cost), 2) AS holding, round(sum(Annual_Orders * 50), 2) AS ordering
FROM valid GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.cost_breakdown(base.valid_orders(spark, folder)), ["Category"], 2, **same("holding", "ordering"))


@register("order_cost_curve", sql(VALID, """,
q AS (SELECT Category, i::INTEGER AS step, 10 + i * (Annual_Demand * 0.5 - 10) / 499 AS quantity, Annual_Demand AS d, Holding_Cost AS h FROM valid, range(500) r(i))
SELECT Category, step, round(avg(quantity), 4) AS quantity, round(sum(quantity / 2 * h), 2) AS holding, round(sum(d / quantity * 50), 2) AS ordering,
  round(sum(quantity / 2 * h + d / quantity * 50), 2) AS total FROM q GROUP BY 1, 2"""))
def _(spark, folder):
    curves = supply.category_curves(base.valid_orders(spark, folder))
    return rounded(curves.withColumn("quantity", F.round("quantity", 4)), ["Category", "step", "quantity"], 2, **same("holding", "ordering", "total"))


@register("orders_per_year", sql(VALID, "SELECT floor(least(Annual_Orders, 52))::INTEGER AS orders_per_year, count(*) AS skus FROM valid GROUP BY 1"))
def _(spark, folder):
    return supply.orders_per_year(base.valid_orders(spark, folder))


@register("monthly_savings", sql(VALID, """SELECT Category, round(sum(greatest(Annual_Demand / 12 / 2 * Holding_Cost + 12 * 50 - Total_Inventory_Cost, 0)), 2) AS savings
FROM valid GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.monthly_savings(base.valid_orders(spark, folder)), ["Category"], 2, **same("savings"))


VENDOR_SQL = ENRICHED + """,
vraw AS (SELECT Vendor_Name, avg(Unit_Cost) AS m1, avg(Stock_Coverage_Ratio) AS m2, avg(CASE WHEN Stock_Status = 'Out of Stock' THEN 1.0 ELSE 0.0 END) * 100 AS m3,
  avg(Lead_Time_Days) AS m4, avg(Inventory_Value) AS m5, count(Product_ID)::DOUBLE AS m6 FROM enriched GROUP BY 1),
vends AS (SELECT min(m1) a1, max(m1) b1, min(m2) a2, max(m2) b2, min(m3) a3, max(m3) b3, min(m4) a4, max(m4) b4, min(m5) a5, max(m5) b5, min(m6) a6, max(m6) b6 FROM vraw),
vscore AS (SELECT Vendor_Name, (
  CASE WHEN b1 > a1 THEN 1 - (m1 - a1) / (b1 - a1) ELSE 0.5 END + CASE WHEN b2 > a2 THEN (m2 - a2) / (b2 - a2) ELSE 0.5 END
  + CASE WHEN b3 > a3 THEN 1 - (m3 - a3) / (b3 - a3) ELSE 0.5 END + CASE WHEN b4 > a4 THEN 1 - (m4 - a4) / (b4 - a4) ELSE 0.5 END
  + CASE WHEN b5 > a5 THEN (m5 - a5) / (b5 - a5) ELSE 0.5 END + CASE WHEN b6 > a6 THEN (m6 - a6) / (b6 - a6) ELSE 0.5 END) / 6 AS score FROM vraw, vends)"""


@register("vendor_scores", sql(VENDOR_SQL, "SELECT Vendor_Name, round(score, 6) AS score FROM vscore"))
def _(spark, folder):
    return rounded(supply.vendor_scores(base.enriched(spark, folder)), ["Vendor_Name"], 6, **same("score"))


@register("vendor_ranking", sql(VENDOR_SQL, """SELECT Vendor_Name, position, round(score, 6) AS score FROM (
SELECT *, row_number() OVER (ORDER BY score DESC, Vendor_Name) AS position FROM vscore) WHERE position <= 10"""))
def _(spark, folder):
    return rounded(supply.ranked_vendors(supply.vendor_scores(base.enriched(spark, folder)), 10), ["Vendor_Name", "position"], 6, **same("score"))


@register("value_composition", sql(CLEAN, """SELECT Category, Vendor_Name, grouping(Category, Vendor_Name) AS level, round(sum(Inventory_Value), 2) AS value,
round(sum(Inventory_Value) / (SELECT sum(Inventory_Value) FROM clean) * 100, 4) AS value_pct FROM clean GROUP BY ROLLUP (Category, Vendor_Name)"""))
def _(spark, folder):
    out = supply.value_composition(base.clean(spark, folder))
    return out.select("Category", "Vendor_Name", "level", F.round("value", 2).alias("value"), F.round("value_pct", 4).alias("value_pct"))


@register("simulation_parameters", sql(CLEAN, """,
p AS (SELECT Category, sum(Inventory_Value) AS value, avg(Daily_Demand_Est) FILTER (Daily_Demand_Est > 0) AS demand_mean,
  stddev_samp(Daily_Demand_Est) FILTER (Daily_Demand_Est > 0) AS dsd, avg(Lead_Time_Days) FILTER (Daily_Demand_Est > 0) AS lead_mean,
  stddev_samp(Lead_Time_Days) FILTER (Daily_Demand_Est > 0) AS lsd, avg(Current_Stock) FILTER (Daily_Demand_Est > 0) AS avg_stock FROM clean GROUP BY 1)
SELECT Category, round(demand_mean, 4) AS demand_mean, round(greatest(coalesce(nullif(dsd, 0), greatest(demand_mean * 0.1, 1)), 1), 4) AS demand_sd,
  round(lead_mean, 4) AS lead_mean, round(greatest(coalesce(nullif(lsd, 0), greatest(lead_mean * 0.1, 1)), 1), 4) AS lead_sd,
  round(avg_stock, 4) AS avg_stock FROM p ORDER BY value DESC, Category LIMIT 6"""))
def _(spark, folder):
    return rounded(supply.simulation_parameters(base.clean(spark, folder)), ["Category"],
                   **same("demand_mean", "demand_sd", "lead_mean", "lead_sd", "avg_stock"))


@register("lead_time_stockouts")
def _(spark, folder):
    return supply.lead_time_stockouts(supply.simulation_parameters(base.clean(spark, folder)))


@register("daily_sum_stockouts")
def _(spark, folder):
    return supply.daily_sum_stockouts(supply.simulation_parameters(base.clean(spark, folder)))


@register("reorder_gap_spread", sql(SUPPLY, """SELECT Category, round(quantile_cont(Reorder_Gap, 0.25), 4) AS q1, round(quantile_cont(Reorder_Gap, 0.5), 4) AS median,
round(quantile_cont(Reorder_Gap, 0.75), 4) AS q3 FROM supply GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.reorder_gap_spread(base.supply(spark, folder)), ["Category"], **same("q1", "median", "q3"))


@register("most_urgent", sql(SUPPLY, """SELECT Product_ID, position, round(Reorder_Gap, 4) AS Reorder_Gap FROM (
SELECT *, row_number() OVER (ORDER BY Reorder_Gap, Product_ID) AS position FROM supply WHERE Reorder_Gap < 0) WHERE position <= 25"""))
def _(spark, folder):
    return rounded(supply.most_urgent(base.supply(spark, folder)), ["Product_ID", "position"], **same("Reorder_Gap"))


@register("replenishment", sql(SUPPLY, """SELECT Product_ID, round(-Reorder_Gap, 4) AS Urgency, round(-Reorder_Gap * Unit_Cost, 4) AS Replenishment_Cost
FROM supply WHERE Reorder_Gap < 0"""))
def _(spark, folder):
    return rounded(supply.replenishment(base.supply(spark, folder)), ["Product_ID"], **same("Urgency", "Replenishment_Cost"))


@register("replenishment_budget", sql(SUPPLY, """SELECT Category, round(sum(-Reorder_Gap * Unit_Cost), 2) AS total_cost, count(*) AS sku_count
FROM supply WHERE Reorder_Gap < 0 GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.replenishment_budget(base.supply(spark, folder)), ["Category", "sku_count"], 2, **same("total_cost"))


@register("demand_variability", sql(CLEAN, f"""SELECT Category, count(Product_ID) AS sku_count, round(avg(Daily_Demand_Est), 4) AS demand_mean,
round(stddev_samp(Daily_Demand_Est), 4) AS demand_std, round(avg(Unit_Cost), 4) AS cost_mean, round(avg(Safety_Stock_Target), 4) AS avg_safety,
round(avg(Current_Stock), 4) AS avg_stock, round(avg(Lead_Time_Days), 4) AS avg_lead, {pct_sql('Out of Stock')} AS oos_rate,
round(CASE WHEN avg(Daily_Demand_Est) > 0 THEN stddev_samp(Daily_Demand_Est) / avg(Daily_Demand_Est) ELSE 0 END, 4) AS cv FROM clean GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.demand_variability(base.clean(spark, folder)), ["Category", "sku_count"],
                   **same("demand_mean", "demand_std", "cost_mean", "avg_safety", "avg_stock", "avg_lead", "oos_rate", "cv"))


@register("coverage_funnel", sql(ENRICHED, """,
b AS (SELECT CASE WHEN c > 3 THEN '>3x Safety Stock' WHEN c > 2 THEN '2-3x Safety Stock' WHEN c > 1 THEN '1-2x Safety Stock' WHEN c > 0.5 THEN '0.5-1x (At Risk)'
  WHEN c > 0 THEN '<0.5x (Critical)' END AS band FROM (SELECT Stock_Coverage_Ratio AS c FROM enriched)
  UNION ALL SELECT 'Zero Stock' FROM enriched WHERE Current_Stock = 0)
SELECT band, count(*) AS skus, round(count(*) * 100.0 / (SELECT count(*) FROM enriched), 4) AS pct FROM b WHERE band IS NOT NULL GROUP BY 1"""))
def _(spark, folder):
    return rounded(supply.coverage_funnel(base.enriched(spark, folder)), ["band", "skus"], **same("pct"))


LEVELS = ENRICHED + """,
levels AS (SELECT i::INTEGER AS step, i * (5.0::DOUBLE / 199) AS ratio,
  (SELECT count(*) FROM enriched WHERE Stock_Coverage_Ratio >= i * (5.0::DOUBLE / 199)) * 100.0 / (SELECT count(*) FROM enriched) AS covered_pct
  FROM range(200) r(i))"""


@register("service_levels", sql(LEVELS, "SELECT step, round(ratio, 6) AS ratio, round(covered_pct, 4) AS covered_pct FROM levels"))
def _(spark, folder):
    out = supply.service_levels(base.enriched(spark, folder))
    return out.select("step", F.round("ratio", 6).alias("ratio"), F.round("covered_pct", 4).alias("covered_pct"))


@register("service_targets", sql(LEVELS, """SELECT t AS target, round(ratio, 6) AS ratio, round(covered_pct, 4) AS covered_pct FROM (
SELECT *, row_number() OVER (PARTITION BY t ORDER BY abs(covered_pct - t), step) AS rn FROM levels, (VALUES (95.0::DOUBLE), (90.0), (80.0)) v(t)) WHERE rn = 1"""))
def _(spark, folder):
    out = supply.service_targets(supply.service_levels(base.enriched(spark, folder)))
    return out.select("target", F.round("ratio", 6).alias("ratio"), F.round("covered_pct", 4).alias("covered_pct"))


@register("oos_by_lead_time", sql(CLEAN, "SELECT Category, " + ", ".join(
    f"round(avg(CASE WHEN Stock_Status = 'Out of Stock' THEN 1.0 ELSE 0.0 END) FILTER (Lead_Time_Days > {a} AND Lead_Time_Days <= {b}) * 100, 4) AS \"{n}\""
    for a, b, n in ((0, 7, "1-7d"), (7, 14, "8-14d"), (14, 21, "15-21d"), (21, 30, "22-30d"))) + " FROM clean GROUP BY 1"))
def _(spark, folder):
    out = supply.oos_by_lead_time(base.clean(spark, folder))
    return out.select("Category", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in supply.LEAD_LABELS])


@register("theoretical_safety_stock", sql(CLEAN, """SELECT Product_ID, round(1.96 * sqrt((SELECT avg(Lead_Time_Days) FROM clean)) * Daily_Demand_Est * 0.5, 4) AS Theoretical_Safety
FROM clean WHERE Daily_Demand_Est > 0"""))
def _(spark, folder):
    return rounded(supply.theoretical_safety_stock(base.clean(spark, folder)), ["Product_ID"], **same("Theoretical_Safety"))
