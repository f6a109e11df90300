"""Registered queries: a spread of them against their SQL on the smallest tables, and rules for all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import close, table

FOLDER = "/root/testdata/sf0.001"
SPREAD = (
    "etl_clean", "etl_counters", "abc_classes", "inventory_kpis", "pareto_categories", "stockout_alerts", "vendor_scores",
    "service_levels", "eoq_by_category", "kruskal_by_vendor", "pair_correlation", "demand_features", "dataset_statistics",
    "forecast_seasonal_trend", "walk_forward_naive", "conformal_intervals", "hierarchy_levels", "ks_statistics", "psi_deciles",
    "concept_drift", "capacity_adjustments", "forecast_adjustments", "scenario_kpis", "quality_demand_suite",
    "contract_quarantine", "run_status", "window_health", "stream_request_metrics", "safety_multipliers",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150 and len(oracles) > 120


def test_entry(spark):
    assert entry.entry(spark).columns == ["Product_ID", "ABC_Class", "Inventory_Value", "Cumulative_Pct"]


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    res = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(close(a, b) for x, y in zip(got[1], want[1]) for a, b in zip(x, y))
