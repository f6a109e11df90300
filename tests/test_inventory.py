"""Cleaning, inventory health and supply chain on products with known values."""

import math

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import etl, inventory, supply
from shelfcast.sources import files
from shelfcast.sources.files import RAW_SCHEMA


def by_id(df):
    return {r["Product_ID"]: r for r in df.collect()}


def test_clean_values(dirty):
    rows = by_id(etl.clean_inventory(dirty))
    want = {
        "K10": (8.25, 64, 36, "Normal Stock", 528), "K11": (40, 0, 21, "Out of Stock", 0), "K12": (12.5, 16, 30, "Low Stock", 200),
        "K13": (150, 30, 15, "Normal Stock", 4500), "K14": (22, 0, 30, "Out of Stock", 0),
    }
    for pid, (cost, stock, point, status, value) in want.items():
        r = rows[pid]
        assert (r.Unit_Cost, r.Current_Stock, r.Reorder_Point, r.Stock_Status, r.Inventory_Value) == (cost, stock, point, status, value)


def test_dirty_rules(spark):
    rows = [
        (" P006\t", "hOME goods", "USD 1,200.50", "abc", -3.0, -1.0, " V ", 0.0),
        ("P007", "HOME GOODS", "-$5", "7", None, 1.0, "V", 2.0),
        ("P008", "home goods ", "1.2.3", None, 1.0, 1.0, "V", 2.0),
        ("P009", "Lonely", "N/A", "1", 1.0, 1.0, "V", None),
        ("P010", None, None, "1", 1.0, 1.0, "V", 1.0),
    ]
    prepared = etl.prepare(spark.createDataFrame(rows, RAW_SCHEMA))
    got = by_id(prepared)
    assert got["P006"].Category == "Home goods" and got["P006"].Vendor_Name == "V"
    assert got["P006"].Unit_Cost == 1200.5 and got["P006"].Current_Stock == 0
    assert got["P006"].Lead_Time_Days == 1 and got["P006"].Daily_Demand_Est == 0
    assert got["P007"].Unit_Cost == 5 and got["P007"].Daily_Demand_Est is None
    # Median of the category (5, 1200.5), then of the filled column (5, 602.75, 1200.5).
    assert got["P008"].Unit_Cost == pytest.approx(602.75)
    assert got["P009"].Unit_Cost == pytest.approx(602.75) and got["P010"].Unit_Cost == pytest.approx(602.75)
    assert got["P009"].Lead_Time_Days is None and got["P009"].Stock_Status == "Normal Stock"
    counters = etl.feed_counters(prepared).head()
    assert (counters.invalid_costs, counters.null_stocks_filled, counters.bad_lead_times) == (3, 2, 1)
    assert (counters.categories_before, counters.categories_after) == (4, 2)


def test_kpis_and_abc(dirty):
    health = inventory.health(etl.clean_inventory(dirty))
    classes = {r.Product_ID: r.ABC_Class for r in health.collect()}
    # The largest holds 86 % of the value, beyond class A; the next reaches 96 %, beyond class B.
    assert classes == {"K10": "C", "K11": "C", "K12": "C", "K13": "B", "K14": "C"}
    k = inventory.kpis(health).head()
    days = (64 / 4 + 16 / 2.5 + 30 / 1) / 5
    assert k.total_inventory_value == 5228 and k.avg_dsi == pytest.approx(days) and k.inventory_turnover == pytest.approx(365 / days)
    assert k.oos_rate == 40.0 and k.slow_moving_value == 0 and (k.abc_a_count, k.abc_b_count, k.abc_c_count) == (0, 1, 4)


def test_abc_does_not_multiply_duplicates(dirty):
    clean = etl.clean_inventory(dirty.unionByName(dirty))
    assert inventory.with_abc(inventory.enrich_base(clean)).count() == 10


def test_order_quantity(dirty):
    row = by_id(supply.enrich_supply(etl.clean_inventory(dirty)))["K10"]
    assert row.EOQ == pytest.approx(math.sqrt(2 * 1460 * 50 / 2.0625))
    assert row.Total_Inventory_Cost == pytest.approx(math.sqrt(2 * 1460 * 50 * 2.0625))


def test_simulation_is_repeatable(dirty):
    params = supply.simulation_parameters(etl.clean_inventory(dirty))
    one, two = (sorted(map(tuple, supply.lead_time_stockouts(params).collect())) for _ in range(2))
    assert one == two and all(0 <= r[2] <= 100 for r in one)
    bins = supply.daily_sum_stockouts(params, n=200).groupBy("Category").agg(F.sum("trials").alias("n"), F.max("bin").alias("b")).collect()
    assert all(r.n == 200 and r.b == 14 for r in bins)


def test_feed_errors(spark, tmp_path):
    empty, wrong, bare = tmp_path / "empty.csv", tmp_path / "wrong.csv", tmp_path / "bare.csv"
    empty.write_text("")
    wrong.write_text("A,B,C\n1,2,3\n")
    bare.write_text(",".join(etl.RAW_COLUMNS) + "\n")
    with pytest.raises(files.FeedError, match="empty"):
        files.read_feed(spark, str(empty))
    with pytest.raises(files.FeedError, match="missing required columns"):
        files.read_feed(spark, str(wrong))
    with pytest.raises(files.FeedError, match="no data rows"):
        files.read_feed(spark, str(bare))
    assert files.looks_like_csv(spark, str(wrong)) and not files.looks_like_csv(spark, str(bare))


def test_file_round_trip(spark, dirty, tmp_path):
    files.write_csv(dirty, str(tmp_path / "feed"))
    (tmp_path / "a_dirty.csv").write_text(",".join(etl.RAW_COLUMNS) + "\nP1,Food,$1,5,1,1,V,2\n")
    back = etl.clean_inventory(files.read_feed(spark, str(tmp_path / "feed")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, etl.clean_inventory(dirty).collect()))
    assert files.newest_file(spark, str(tmp_path)).head().path.endswith("a_dirty.csv")
    for _ in range(2):
        files.append_snapshot(back, str(tmp_path / "snap"), "b1")
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 5
