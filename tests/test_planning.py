"""Drift, capacity, sensing, scenarios, quality, contracts, history and the full batch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import batch, capacity, contracts, drift, history, quality, scenarios, sensing

# ---- drift -----------------------------------------------------------------------------------------------------


def normals(spark, seed, **columns):
    rng = np.random.default_rng(seed)
    data = {k: rng.normal(*v, 500) for k, v in columns.items()}
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], ", ".join(f"{k} double" for k in data))


def test_same_distribution_does_not_drift(spark):
    a, b = (normals(spark, s, x=(0, 1), y=(10, 2)) for s in (1, 2))
    assert drift.data_drift(drift.ks_statistics(a, b, ["x", "y"])).where("is_drifted").count() == 0


def test_shift_drifts(spark):
    a, b = normals(spark, 1, x=(0, 1)), normals(spark, 2, x=(5, 1))
    row = drift.data_drift(drift.ks_statistics(a, b, ["x"])).head()
    assert row.is_drifted and row.statistic > 0.9
    assert drift.ks_statistics(a.limit(9), b, ["x"]).count() == 0


def test_ks_against_direct(spark):
    a, b = normals(spark, 3, x=(0, 1)), normals(spark, 4, x=(0.1, 1))
    x, y = (np.sort([r.x for r in d.collect()]) for d in (a, b))
    grid = np.r_[x, y]
    want = np.abs(np.searchsorted(x, grid, "right") / 500 - np.searchsorted(y, grid, "right") / 500).max()
    assert drift.ks_statistics(a, b, ["x"]).head().statistic == pytest.approx(want)


def test_psi(spark):
    a, same, far = normals(spark, 1, x=(100, 10)), normals(spark, 2, x=(100, 10)), normals(spark, 3, x=(200, 10))
    assert not drift.prediction_verdict(drift.psi_equal_width(a, same, "x")).head().is_drifted
    bad = drift.prediction_verdict(drift.psi_equal_width(a, far, "x")).head()
    assert bad.is_drifted and bad.interpretation == "significant"
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert drift.psi_equal_width(flat, a, "x").head().psi == 0
    r, c = (np.array([v.x for v in d.collect()]) for d in (a, same))
    edges = np.quantile(r, np.linspace(0, 1, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = (np.histogram(v, edges)[0] / 500 + 1e-6 for v in (r, c))
    assert drift.psi_deciles(a, same, "x").head().psi == pytest.approx(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize("errors, action", [([10] * 10, "MONITOR"), ([10] * 3 + [25] * 7, "AUTO_RETRAIN"), ([30] * 6, "insufficient_history"), ([25] * 6 + [20], "MONITOR")])
def test_concept_drift(spark, errors, action):
    df = spark.createDataFrame([("m", i, float(e)) for i, e in enumerate(errors)], "model string, ds int, mape double")
    assert drift.concept_drift(df).head().action == action
    assert (drift.breach_streaks(df).count() > 0) == (action == "AUTO_RETRAIN")


def test_combined(spark):
    a = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    assert not drift.combined_verdict(a, a, "k", "v").head().drift_detected
    assert drift.combined_verdict(a, a.withColumn("v", F.col("v") * 3), "k", "v").head().drift_detected


# ---- capacity --------------------------------------------------------------------------------------------------


def weeks(spark, values):
    return spark.createDataFrame([(f"W{i + 1}", float(v)) for i, v in enumerate(values)], "period string, demand double")


def test_feasible_weeks(spark):
    profiles = spark.createDataFrame([("north", 700.0, 0.9), ("south", 900.0, 0.8)], "line_id string, max_throughput_per_day double, efficiency_factor double")
    used = capacity.utilization(weeks(spark, [2835, 4725, 6615, 945]), capacity.daily_capacity(profiles))
    assert [round(r.utilization, 4) for r in used.orderBy("period").collect()] == [0.3, 0.5, 0.7, 0.1]
    r = capacity.feasibility(used).head()
    assert r.feasible and r.demand_coverage == 1 and round(r.avg_utilization, 4) == 0.4


def test_overload_and_empty(spark):
    cap = capacity.daily_capacity(capacity.default_profiles(spark))
    used = capacity.utilization(weeks(spark, [400_000]), cap)
    assert not capacity.feasibility(used).head().feasible and used.head().utilization == 2.0
    assert capacity.adjustments(capacity.bottlenecks(used)).head().action == "outsource"
    empty = capacity.feasibility(capacity.utilization(weeks(spark, [1]).limit(0), cap)).head()
    assert empty.feasible and empty.avg_utilization == 0 and empty.demand_coverage == 1
    small = spark.createDataFrame([("W1", 1700.0)], "period string, deficit double")
    row = capacity.adjustments(small).head()
    assert row.action == "overtime" and row.estimated_cost == 7 * 600 and row.additional_capacity == 7 * 1500


# ---- sensing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def signals(spark):
    rows = [
        ("pos", "day_4", "mug", 40.0, 0.7), ("pos", "day_4", "mug", 44.0, 0.6), ("social", "day_5", "mug", 42.0, 0.5),
        ("weather", "day_5", "mug", 41.0, 0.9), ("pos", "day_6", "mug", 43.0, 0.8), ("social", "day_6", "mug", 42.0, 0.4),
        ("pos", "day_7", "mug", 90.0, 0.6), ("pos", "day_7", "lamp", 75.0, 0.9),
    ]
    return spark.createDataFrame(rows, "source string, timestamp string, product_id string, signal_value double, confidence double")


def test_spikes(signals):
    found = sensing.spikes(signals, 2.0).collect()
    values = np.array([40, 44, 42, 41, 43, 42, 90])
    assert len(found) == 1 and found[0].signal_value == 90 and found[0].sigma == pytest.approx((90 - values.mean()) / values.std(ddof=1))
    assert sensing.spikes(signals).count() == 0


def test_adjustment(spark, signals):
    base = spark.createDataFrame([("mug", 1, 45.0), ("lamp", 1, 60.0), ("rug", 1, 20.0)], "product_id string, period int, forecast double")
    rows = {r.product_id: r for r in sensing.adjust_forecast(base, signals).collect()}
    assert rows["lamp"].adjusted_forecast == pytest.approx(0.7 * 60 + 0.3 * 75) and rows["lamp"].adjustment_pct == pytest.approx(7.5)
    assert rows["rug"].adjusted_forecast == 20 and rows["rug"].adjustment_pct == 0
    kpi = sensing.sensing_kpis(signals, sensing.spikes(signals, 2.0), sensing.adjust_forecast(base, signals)).head()
    assert (kpi.active_signals, kpi.spike_count, kpi.products_sensed) == (8, 1, 3)


def test_weight_rules(spark):
    rows = [("pos", "day_13", 1.0), ("pos", "day_6", 1.0), ("other", "bad", 1.0)]
    df = spark.createDataFrame(rows, "source string, timestamp string, confidence double").withColumn("w", sensing.signal_weight())
    got = [r.w for r in df.collect()]
    assert got == pytest.approx([0.6 * 0.5, 0.6 * 0.5 * 0.5, 0.3 * 0.5 * 0.5 ** (13 / 7)])


# ---- scenarios -------------------------------------------------------------------------------------------------


def numbered(spark, values):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "period int, demand double")


def one_scenario(spark, reliability=1.0):
    return spark.createDataFrame([(0, "base", 1.0, 1.0, reliability)], "number int, scenario string, demand_multiplier double, capacity_multiplier double, supply_reliability double")


def test_known_balance(spark):
    details = scenarios.simulate(numbered(spark, [900, 1000, 700]), F.lit(150.0), one_scenario(spark), mode="always", horizon_days=21)
    assert [round(r.inventory) for r in details.orderBy("period").collect()] == [465, 515, 865]
    k = scenarios.scenario_kpis(details).head()
    assert k.fill_rate == 1 and k.avg_utilization == pytest.approx(2600 / 3150, abs=1e-3) and k.inventory_cost == pytest.approx(615 * 0.25 * 21 / 365) and k.stockout_events == 0


def test_stockouts_and_seed(spark):
    args = (numbered(spark, [70_000, 40]), F.lit(100.0), one_scenario(spark, 0.5))
    one = scenarios.scenario_kpis(scenarios.simulate(*args)).head()
    assert one.fill_rate < 1 and one.stockout_events > 0 and one.periods == 12
    assert one == scenarios.scenario_kpis(scenarios.simulate(*args)).head()


def test_balance_equals_loop(spark):
    rng = np.random.default_rng(0)
    demand = rng.uniform(0, 2000, 12)
    details = scenarios.simulate(numbered(spark, demand), F.lit(130.0), one_scenario(spark, 0.6)).orderBy("period").collect()
    inventory = 130 * 7 * 0.3
    for r in details:
        arrived = [a for a in (910.0, 637.0) if abs(min(r.demand, inventory + a) - r.fulfilled) < 1e-6 and abs(inventory + a - r.fulfilled - r.inventory) < 1e-6]
        assert arrived, r
        inventory = r.inventory


def test_resize_repeats(spark):
    got = [r.demand for r in scenarios.resize_periods(numbered(spark, [1, 2, 3]), 7).orderBy("period").collect()]
    assert got == [1, 2, 3, 1, 2, 3, 1]


# ---- quality and contracts -------------------------------------------------------------------------------------


def test_demand_suite(spark, tmp_path):
    good = spark.createDataFrame([("2024-01-01", "P1", 5.0, 2.0, "Food"), ("2024-01-02", "P2", 7.0, 3.0, "Home")], "date string, product_id string, demand double, price double, category string")
    results = quality.run_suite(good, quality.DEMAND_SUITE)
    assert quality.suite_summary(results).head().success
    bad = good.unionByName(spark.createDataFrame([("01/02/2024", None, None, -1.0, "Cars")], good.schema))
    failed = {r.rule for r in quality.run_suite(bad, quality.DEMAND_SUITE).where("not passed").collect()}
    assert failed == {3, 4, 6, 8, 9, 10, 11}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"expectations": [
        {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "category"}},
        {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "missing"}},
        {"expectation_type": "expect_something_else", "kwargs": {}},
        {"expectation_type": "expect_column_mean_to_be_between", "kwargs": {"column": "demand"}},
    ]}))
    rows = quality.run_suite(good, quality.load_suite(str(path))).orderBy("rule").collect()
    assert [r.passed for r in rows] == [True, False, True, False]
    quality.write_report(results, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 14


def test_inventory_suite(spark):
    rows = [("2024-01-01", f"P{i}", 5, w, 1.0, 3.0, 2.0, "x") for i, w in enumerate(["NYC", "LAX", "CHI"])]
    df = spark.createDataFrame(rows, "date string, product_id string, inventory_level long, warehouse string, reorder_point double, lead_time_days double, unit_cost double, extra string")
    assert quality.suite_summary(quality.run_suite(df, quality.INVENTORY_SUITE)).head().success
    assert not quality.suite_summary(quality.run_suite(df.where("warehouse <> 'CHI'"), quality.INVENTORY_SUITE)).head().success


def test_contract_split_and_stop(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "1.5"), (None, "2024-01-01", "2"), ("b", "soon", "-1")], "unique_id string, ds string, y string")
    valid, rejected = contracts.enforce(df, contracts.DEMAND)
    assert valid.count() == 1 and valid.head().y == 1.5
    assert sorted(tuple(r.violations) for r in rejected.collect()) == [("ds", "y"), ("unique_id",)]
    with pytest.raises(Exception, match="contract broken by"):
        contracts.require(df, contracts.DEMAND).collect()
    assert contracts.require(valid, contracts.DEMAND).count() == 1
    with pytest.raises(contracts.ContractError, match="unexpected"):
        contracts.coerce(df.withColumn("z", F.lit(1)), contracts.DEMAND)
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.coerce(df.drop("y"), contracts.DEMAND)
    nan = spark.createDataFrame([("m", float("nan"), 1.0, 1.0, "extra")], "model string, mape double, rmse double, mae double, note string")
    assert contracts.enforce(nan, contracts.EVALUATION)[0].head().mape is None


# ---- history and batch -----------------------------------------------------------------------------------------


def test_progress_and_types(spark):
    df = spark.createDataFrame([("etl", "running"), ("stats", "completed"), ("sop", "completed"), ("ml", "failed")], "stage string, status string")
    got = [r[0] for r in df.select(history.stage_progress(F.col("stage"), F.col("status"))).collect()]
    assert got == [0, 28, 100, 0]
    with pytest.raises(ValueError, match="analysis type"):
        history.analysis_of(df, "nope")


def test_full_batch(spark, dirty, tmp_path):
    more = dirty
    for i in range(4):
        more = more.unionByName(dirty.withColumn("Product_ID", F.concat(F.col("Product_ID"), F.lit(f"x{i}"))).withColumn("Current_Stock_Raw", F.lit(str(20 * i))))
    status = batch.run_batch(more, "b1", str(tmp_path)).collect()
    assert [(r.stage, r.status) for r in status] == [(s, "completed") for s in batch.STAGES], [r.error for r in status]
    results = spark.read.parquet(str(tmp_path / "results"))
    assert results.count() == 7 and spark.read.parquet(str(tmp_path / "snapshots")).count() == 25
    stats = json.loads(results.where("analysis_type = 'stats'").head().result_json)
    assert stats["total_skus"] == 25


def test_failing_stage_is_recorded(spark, dirty, tmp_path):
    def boom(prepared, clean):
        raise RuntimeError("no model")

    steps = {**batch.stage_functions(None), "supply_chain": boom}
    status = batch.run_batch(dirty, "b2", str(tmp_path), stages=steps).collect()
    assert [(r.stage, r.status) for r in status] == [("etl", "completed"), ("stats", "completed"), ("supply_chain", "failed")]
    assert status[-1].error == "no model"
