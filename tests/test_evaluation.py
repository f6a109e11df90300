"""Metrics, folds, significance, conformal intervals and reconciliation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.forecasting import closed_form, evaluation
from shelfcast.functions import tails
from shelfcast.operators import hierarchy


def score(spark, y, f):
    df = spark.createDataFrame(list(zip(map(float, y), map(float, f))), "y double, y_hat double")
    return evaluation.scores(df).head()


def test_known_metrics(spark):
    assert score(spark, [100, 200], [110, 180]).mape == pytest.approx(10)
    assert score(spark, [0, 100], [5, 110]).mape == pytest.approx(10)
    assert score(spark, [0, 100], [5, 110]).mape_eps == pytest.approx((4 + 0.1) / 2 * 100)
    assert score(spark, [0], [5]).mape is None
    assert score(spark, [1, 2], [2, 4]).rmse == pytest.approx(np.sqrt(2.5))
    assert score(spark, [1, 2, 3], [2, 2, 5]).mae == pytest.approx(1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 1000), st.floats(0, 1000)), min_size=1, max_size=20))
def test_metric_rules(spark, pairs):
    r = score(spark, *zip(*pairs))
    assert r.rmse >= r.mae - 1e-9 and (r.mape is None or r.mape >= 0)
    same = score(spark, *zip(*[(a, a) for a, _ in pairs]))
    assert not same.mape


def paired(spark, base, model):
    return spark.createDataFrame([("m", i, float(b), float(v)) for i, (b, v) in enumerate(zip(base, model))], "model string, fold int, base double, mape double")


def test_signed_rank(spark):
    base = [20, 22, 21, 23, 20.5, 21.5, 22.5]
    r = evaluation.signed_rank(paired(spark, base, [b - 10 for b in base])).head()
    assert r.significant and r.p_value == pytest.approx(1 / 128) and r.stars == "**"
    few = evaluation.signed_rank(paired(spark, [1, 2], [0, 1])).head()
    assert not few.significant and few.p_value is None
    none = evaluation.signed_rank(paired(spark, base, base)).head()
    assert none.p_value == 1.0 and none.statistic == 0 and not none.significant


def test_signed_rank_exact_against_enumeration():
    ranks = [1.5, 1.5, 3, 4.5, 4.5, 6]
    for w in (0, 6, 12.5, 21):
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=6)]
        assert tails.signed_rank_p(ranks, w) == pytest.approx(np.mean([s >= w for s in sums]))


def test_effect_size(spark):
    r = evaluation.effect_size(paired(spark, [20, 21, 22, 20.5, 21.5], [10, 11, 12, 10.5, 11.5])).head()
    assert r.d > 0.8 and r.magnitude == "L"
    flat = evaluation.effect_size(paired(spark, [1, 1], [1, 1])).head()
    assert flat.d == 0 and flat.magnitude == "N/A"


def test_interval(spark):
    one = evaluation.mean_interval(spark.createDataFrame([("m", 5.0)], "model string, mape double")).head()
    assert (one.lo, one.hi) == (5.0, 5.0)
    many = evaluation.mean_interval(spark.createDataFrame([("m", float(x)) for x in range(10)], "model string, mape double")).head()
    assert many.hi - many.mean == pytest.approx(2.262157 * np.std(range(10), ddof=1) / np.sqrt(10), rel=1e-5)


def test_conformal(spark):
    y = [10, 11, 12, 9, 13, 8, 14, 7, 15, 6]
    df = spark.createDataFrame([(float(v), 10.0) for v in y], "y double, y_hat double")
    q = evaluation.calibrate(df).head().half_width
    assert q == pytest.approx(np.quantile(np.abs(np.array(y) - 10), min(1, 0.9 * 1.1)))
    out = evaluation.conformal_intervals(df, F.lit(q)).collect()
    assert all(0 <= r.y_lo_90 <= r.y_hat <= r.y_hi_90 for r in out)


def test_folds(spark):
    days = pd.DataFrame({"unique_id": "a", "ds": pd.date_range("2023-01-01", periods=200).date, "y": 1.0})
    df = spark.createDataFrame(days, "unique_id string, ds date, y double")
    rows = evaluation.folds(df).orderBy("fold").collect()
    assert len(rows) == 5  # the sixth would train on fewer than sixty days
    assert str(rows[0].test_end) == "2023-07-19" and (rows[0].test_end - rows[0].test_start).days == 13
    assert all((r.test_start - r.train_end).days == 1 for r in rows)
    assert all(r.mape == 0 and r.n == 14 for r in evaluation.walk_forward(df, closed_form.naive).collect())


def test_champion(spark):
    table = spark.createDataFrame([("a", 30.0), ("b", 12.0), ("c", None)], "model string, mape_mean double")
    r = evaluation.champion(table).head()
    assert r.champion == "b" and r.passed


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert tails.f_upper(4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)
    assert tails.t_quantile(0.975, 11) == pytest.approx(2.200985, rel=1e-6)
    assert tails.kolmogorov_p(0.05, 500, 500) == pytest.approx(0.5595, rel=1e-3)


# ---- hierarchy -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(3)
    static = [(f"s{w}{c}{i}", f"w{w}", f"c{c}", f"c{c}x") for w in range(3) for c in range(2) for i in range(2 + w)]
    nodes = [("national", "Total", [s[0] for s in static])]
    for w in sorted({s[1] for s in static}):
        nodes.append(("warehouse", w, [s[0] for s in static if s[1] == w]))
    for k in sorted({(s[1], s[2], s[3]) for s in static}):
        nodes.append(("category", "/".join(k), [s[0] for s in static if s[1:] == k]))
    nodes += [("sku", s[0], [s[0]]) for s in static]
    matrix = np.array([[1.0 if s[0] in members else 0.0 for s in static] for _, _, members in nodes])
    y = rng.uniform(50, 100, (2, len(nodes)))
    w = rng.uniform(0.5, 4, len(nodes))
    rows = [(n[0], n[1], f"2024-01-0{d + 1}", float(y[d, i])) for d in range(2) for i, n in enumerate(nodes)]
    forecasts = spark.createDataFrame(rows, "level string, unique_id string, ds string, y_hat double").withColumn("ds", F.col("ds").cast("date"))
    weights = spark.createDataFrame([(n[0], n[1], float(v)) for n, v in zip(nodes, w)], "level string, unique_id string, variance double")
    return spark.createDataFrame(static, "unique_id string, warehouse string, category string, subcategory string"), nodes, matrix, y, w, forecasts, weights


def reconciled(df, nodes, day=1):
    got = {(r.level, r.unique_id): r.y_hat_reconciled for r in df.where(F.dayofmonth("ds") == day).collect()}
    return np.array([got[(n[0], n[1])] for n in nodes])


@pytest.mark.parametrize("method", ["mint_ols", "mint_wls", "bottom_up", "mint_shrink"])
def test_reconciliation_equals_dense_solution(tree, method):
    static, nodes, s, y, w, forecasts, weights = tree
    got = reconciled(hierarchy.reconcile(forecasts, static, method, weights), nodes)
    if method == "bottom_up":
        want = s @ y[0][-s.shape[1]:]
    else:
        wi = np.diag(1 / w) if method == "mint_wls" else np.eye(len(w))
        want = s @ np.linalg.solve(s.T @ wi @ s, s.T @ wi @ y[0])
    np.testing.assert_allclose(got, np.maximum(0, want), rtol=1e-9)


def test_missing_node_counts_as_zero(tree):
    static, nodes, s, y, w, forecasts, weights = tree
    gone = forecasts.where("unique_id <> 'w1'")
    y0 = y[0].copy()
    y0[[n[1] for n in nodes].index("w1")] = 0
    want = s @ np.linalg.solve(s.T @ s, s.T @ y0)
    np.testing.assert_allclose(reconciled(hierarchy.reconcile(gone, static), nodes), np.maximum(0, want), rtol=1e-9)


def test_levels_are_coherent(spark, tree):
    static, nodes = tree[0], tree[1]
    bottom = spark.createDataFrame([(n[1], 1.5) for n in nodes if n[0] == "sku"], "unique_id string, y double").withColumn("ds", F.lit("2024-01-01").cast("date"))
    rolled = hierarchy.aggregate_levels(bottom, static)
    assert hierarchy.incoherent_days(rolled).count() == 0
    assert rolled.where("level = 'national'").head().y == pytest.approx(1.5 * 18)
    assert hierarchy.nodes(static).groupBy("level").count().count() == 4
