"""Shared inputs of the registered queries, and the same inputs as SQL for checking.

Inputs that many queries read are pinned once per session and folder, as a nightly job would store them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.etl import clean_inventory, prepare
from shelfcast.operators.inventory import enrich_base, health
from shelfcast.operators.supply import enrich_supply
from shelfcast.operators.supply import valid_orders as valid_rows
from shelfcast.session import file_system, pin, work_folder
from shelfcast.sources import feeds

_PINNED: dict[tuple[str, str, str, tuple], DataFrame] = {}

Query = Callable[[SparkSession, str], DataFrame]


def file_state(spark: SparkSession, folder: str) -> tuple:
    """Name, size and modification time of everything in a folder and one level below."""
    fs, at = file_system(spark, folder)
    found = []
    for x in fs.listStatus(at):
        for y in fs.listStatus(x.getPath()) if x.isDirectory() else [x]:
            found.append((y.getPath().toString(), y.getLen(), y.getModificationTime()))
    return tuple(sorted(found))


def pinned(spark: SparkSession, folder: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` gives, stored once per session and state of the folder's files."""
    key = (work_folder(spark), folder, label, file_state(spark, folder))
    if key not in _PINNED:
        _PINNED[key] = pin(build(), label)
    return _PINNED[key]


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return pinned(spark, folder, "raw", lambda: feeds.raw_inventory(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return pinned(spark, folder, "clean", lambda: clean_inventory(raw(spark, folder)))


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return enrich_base(clean(spark, folder))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return pinned(spark, folder, "health", lambda: health(clean(spark, folder)))


def supply(spark: SparkSession, folder: str) -> DataFrame:
    return enrich_supply(clean(spark, folder))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(raw(spark, folder))


def valid_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Rows below the 99th percentile fence, which several queries read."""
    return pinned(spark, folder, "valid-orders", lambda: valid_rows(supply(spark, folder)))


def brand_demand(spark: SparkSession, folder: str) -> DataFrame:
    return pinned(spark, folder, "brand", lambda: feeds.brand_demand(spark, folder))


def sku_facts(spark: SparkSession, folder: str) -> DataFrame:
    return pinned(spark, folder, "sku", lambda: feeds.sku_facts(spark, folder))


def sku_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse series with their gaps filled by zeros."""
    return pinned(spark, folder, "sku-daily", lambda: feeds.calendar_spine(feeds.demand_of(sku_facts(spark, folder))))


# --------------------------------------------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------------------------------------------

RAW = """
daily AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
sales AS (
  SELECT l_partkey, sum(qty) / count(day) AS per_day FROM daily GROUP BY 1),
last_sale AS (
  SELECT l_partkey, l_suppkey FROM (
    SELECT l_partkey, l_suppkey, row_number() OVER (
      PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_suppkey DESC) AS rn
    FROM lineitem) WHERE rn = 1),
raw AS (
  SELECT p_partkey AS part_key,
    CASE WHEN p_partkey % 7 = 0 THEN '  P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || chr(9)
         ELSE 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS Product_ID,
    CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN ' ' || p_type
         ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS Category,
    CASE WHEN p_partkey % 11 = 1 THEN '$' || CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR)
         WHEN p_partkey % 11 = 2 THEN 'USD ' || CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR)
         WHEN p_partkey % 41 = 0 THEN 'N/A' WHEN p_partkey % 43 = 0 THEN NULL WHEN p_partkey % 47 = 0 THEN '1.2.3'
         ELSE CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR) END AS Unit_Cost_Raw,
    CASE WHEN p_partkey % 13 = 0 THEN '0' WHEN p_partkey % 17 = 0 THEN '-5' WHEN p_partkey % 19 = 0 THEN 'abc'
         WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 2000 AS VARCHAR) END AS Current_Stock_Raw,
    CASE WHEN p_partkey % 29 = 0 THEN -1.0 WHEN p_partkey % 53 = 0 THEN 0.0 ELSE per_day END::DOUBLE AS Daily_Demand_Est,
    CASE WHEN p_partkey % 31 = 0 THEN 0.0 WHEN p_partkey % 37 = 0 THEN -10.0 ELSE p_size * 5.0 END::DOUBLE AS Safety_Stock_Target,
    CASE WHEN p_partkey % 5 = 0 THEN ' ' || s_name || '  ' ELSE s_name END AS Vendor_Name,
    CAST(p_size % 31 AS DOUBLE) AS Lead_Time_Days
  FROM part LEFT JOIN sales ON p_partkey = sales.l_partkey
            LEFT JOIN last_sale ON p_partkey = last_sale.l_partkey
            LEFT JOIN supplier ON s_suppkey = last_sale.l_suppkey)"""

PARSED = RAW + """,
parsed AS (
  SELECT part_key, Category AS Category_Raw,
    regexp_replace(Product_ID, '^\\s+|\\s+$', '', 'g') AS Product_ID,
    upper(substr(trim(Category), 1, 1)) || lower(substr(trim(Category), 2)) AS Category,
    CASE WHEN regexp_matches(Unit_Cost_Raw, '[0-9]')
         THEN try_cast(regexp_replace(Unit_Cost_Raw, '[^0-9.]', '', 'g') AS DOUBLE) END AS Parsed_Cost,
    try_cast(Current_Stock_Raw AS DOUBLE) AS Parsed_Stock,
    Daily_Demand_Est AS Demand_Raw, Safety_Stock_Target AS Safety_Raw,
    trim(Vendor_Name) AS Vendor_Name, Lead_Time_Days AS Parsed_Lead
  FROM raw),
catmed AS (SELECT Category, quantile_cont(Parsed_Cost, 0.5) AS m FROM parsed GROUP BY 1),
filled1 AS (SELECT parsed.*, coalesce(Parsed_Cost, m) AS c1 FROM parsed LEFT JOIN catmed USING (Category)),
prepared AS (
  SELECT Product_ID, Category, Category_Raw, Parsed_Cost, Parsed_Stock, Parsed_Lead, Unit_Cost, Current_Stock,
    Daily_Demand_Est, Safety_Stock_Target, Vendor_Name, Lead_Time_Days, Reorder_Point,
    CASE WHEN Current_Stock = 0 THEN 'Out of Stock' WHEN Current_Stock < Reorder_Point THEN 'Low Stock'
         ELSE 'Normal Stock' END AS Stock_Status,
    Current_Stock * Unit_Cost AS Inventory_Value
  FROM (SELECT *, Daily_Demand_Est * Lead_Time_Days + Safety_Stock_Target AS Reorder_Point FROM (
    SELECT *, coalesce(c1, (SELECT quantile_cont(c1, 0.5) FROM filled1)) AS Unit_Cost,
      CASE WHEN Parsed_Stock IS NULL OR Parsed_Stock < 0 THEN 0.0 ELSE Parsed_Stock END::DOUBLE AS Current_Stock,
      CASE WHEN Demand_Raw < 0 THEN 0.0 ELSE Demand_Raw END::DOUBLE AS Daily_Demand_Est,
      CASE WHEN Safety_Raw < 0 THEN 0.0 ELSE Safety_Raw END::DOUBLE AS Safety_Stock_Target,
      CASE WHEN Parsed_Lead < 1 THEN 1.0 ELSE Parsed_Lead END::DOUBLE AS Lead_Time_Days
    FROM filled1)))"""

CLEAN = PARSED + """,
clean AS (SELECT Product_ID, Category, Unit_Cost, Current_Stock, Daily_Demand_Est, Safety_Stock_Target, Vendor_Name,
                 Lead_Time_Days, Reorder_Point, Stock_Status, Inventory_Value FROM prepared)"""

ENRICHED = CLEAN + """,
enriched AS (
  SELECT *, CASE WHEN Daily_Demand_Est > 0 THEN Current_Stock / Daily_Demand_Est ELSE 999.0 END AS DSI,
    CASE WHEN Safety_Stock_Target > 0 THEN Current_Stock / Safety_Stock_Target ELSE 0.0 END AS Stock_Coverage_Ratio,
    Daily_Demand_Est * Unit_Cost AS Demand_Intensity
  FROM clean)"""

HEALTH = ENRICHED + """,
health AS (
  SELECT *, CASE WHEN Cumulative_Pct <= 80 THEN 'A' WHEN Cumulative_Pct <= 95 THEN 'B' ELSE 'C' END AS ABC_Class
  FROM (SELECT *, DSI AS Days_to_Deplete,
      CASE WHEN Reorder_Point - Current_Stock < 0 THEN 0.0 ELSE Reorder_Point - Current_Stock END AS Suggested_Reorder,
      Lead_Time_Days / (SELECT max(Lead_Time_Days) FROM enriched) * 0.4
        + (1 - least(greatest(Stock_Coverage_Ratio, 0), 3) / 3) * 0.4
        + Daily_Demand_Est / (SELECT max(Daily_Demand_Est) FROM enriched) * 0.2 AS Supply_Risk_Score,
      sum(Inventory_Value) OVER (ORDER BY Inventory_Value DESC NULLS LAST, Product_ID ROWS UNBOUNDED PRECEDING)
        / (SELECT sum(Inventory_Value) FROM enriched) * 100 AS Cumulative_Pct
    FROM enriched))"""

SUPPLY = ENRICHED + """,
supply0 AS (
  SELECT *, Daily_Demand_Est * 365 AS Annual_Demand, Current_Stock - Reorder_Point AS Reorder_Gap,
    Unit_Cost * 0.25 AS Holding_Cost FROM enriched),
supply1 AS (
  SELECT *, CASE WHEN Annual_Demand > 0 AND Holding_Cost > 0 THEN sqrt(2 * Annual_Demand * 50 / Holding_Cost)
    ELSE 0.0 END AS EOQ FROM supply0),
supply2 AS (
  SELECT *, CASE WHEN EOQ > 0 THEN Annual_Demand / EOQ ELSE 0.0 END AS Annual_Orders FROM supply1),
supply AS (
  SELECT *, EOQ / 2 * Holding_Cost + Annual_Orders * 50 AS Total_Inventory_Cost FROM supply2)"""

VALID = SUPPLY + """,
valid AS (SELECT * FROM supply WHERE EOQ > 0 AND EOQ < (SELECT quantile_cont(EOQ, 0.99) FROM supply))"""

BRAND = """
y AS (
  SELECT p_brand AS unique_id, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SKU = """
facts AS (
  SELECT r_name || '|' || p_type || '|' || p_brand AS unique_id, r_name AS warehouse, p_type AS category,
    p_type || '-' || CAST(CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) % 5 AS VARCHAR) AS subcategory,
    CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y, avg(l_extendedprice / l_quantity) AS price,
    avg(l_discount) AS discount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

SKU_DAILY = SKU + """,
spans AS (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM facts GROUP BY 1),
days AS (SELECT unique_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS ds FROM spans),
y AS (SELECT unique_id, ds, coalesce(facts.y, 0.0) AS y FROM days LEFT JOIN facts USING (unique_id, ds))"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
