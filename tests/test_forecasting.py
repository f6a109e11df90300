"""Models against direct computation, and rules every model must keep."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.forecasting import closed_form, evaluation, registry, regression, trees
from shelfcast.operators import features

H = 14


def series(name, values, start="2023-01-01"):
    return pd.DataFrame({"unique_id": name, "ds": pd.date_range(start, periods=len(values)).date, "y": np.asarray(values, float)})


@pytest.fixture(scope="module")
def demand(spark):
    rng = np.random.default_rng(1)
    t = np.arange(120)
    parts = [series(f"regular{i}", rng.uniform(10, 50) + rng.normal(0, 5, 120) + 3 * np.sin(2 * np.pi * t / 7)) for i in range(3)]
    parts.append(series("intermittent", np.where(rng.random(120) < 0.8, 0, rng.uniform(5, 30, 120))))
    parts.append(series("cold", rng.uniform(5, 20, 30)))
    parts += [series(f"tiny{n}", rng.uniform(5, 20, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 13)]
    pdf = pd.concat(parts)
    pdf["y"] = pdf["y"].clip(lower=0)
    return pdf, spark.createDataFrame(pdf, "unique_id string, ds date, y double")


def paths(df):
    pdf = df.toPandas().sort_values(["unique_id", "ds"])
    return {k: g["y_hat"].to_numpy() for k, g in pdf.groupby("unique_id")}


def groups(pdf):
    return {k: g.sort_values("ds") for k, g in pdf.groupby("unique_id")}


@pytest.mark.parametrize("name", [*registry.FOLDABLE])
def test_shape_and_sign(demand, name):
    pdf, df = demand
    out = registry.create(name)(df, H).toPandas()
    assert list(out.columns) == ["unique_id", "ds", "y_hat"] and (out["y_hat"] >= 0).all() and out["y_hat"].notna().all()
    last = pdf.groupby("unique_id")["ds"].max()
    for uid, g in out.groupby("unique_id"):
        assert sorted(g["ds"]) == [last[uid] + dt.timedelta(days=i) for i in range(1, H + 1)]
    assert set(out["unique_id"]) == set(groups(pdf))


def test_unknown_model():
    with pytest.raises(ValueError, match="Unknown model"):
        registry.create("nope")
    assert len(registry.available_models()) == 10


def test_naive(demand):
    pdf, df = demand
    got = paths(closed_form.naive(df, H))
    for uid, g in groups(pdf).items():
        np.testing.assert_allclose(got[uid], g["y"].tail(30).mean())


def test_zero_shot_is_the_recent_mean_of_any_horizon(demand):
    pdf, df = demand
    got = paths(closed_form.zero_shot(df, 30))
    for uid, g in groups(pdf).items():
        np.testing.assert_allclose(got[uid], [g["y"].tail(30).mean()] * 30)


def test_weighted_trend(demand):
    pdf, df = demand
    got = paths(closed_form.weighted_trend(df, H))
    for uid, g in groups(pdf).items():
        y = g["y"].to_numpy()
        a = 2 / (min(30, len(y)) + 1)
        w = (1 - a) ** np.arange(len(y))[::-1]
        tail = y[-30:]
        slope = np.polyfit(range(len(tail)), tail, 1)[0] if len(tail) > 1 else 0
        np.testing.assert_allclose(got[uid], np.maximum(0, w @ y / w.sum() + slope * np.arange(1, H + 1)), atol=1e-8)


def test_trend_harmonics(demand):
    pdf, df = demand
    got = paths(closed_form.trend_harmonics(df, H))
    for uid, g in groups(pdf).items():
        y = g["y"].to_numpy()
        n = len(y)
        t = np.arange(n)
        coef = np.polyfit(t, y, min(2, max(1, n - 1))) if n > 1 else np.array([0.0, y[0]])
        rest, period, at = y - np.polyval(coef, t), min(7.0, n / 2), np.arange(n, n + H)
        want = np.polyval(coef, at)
        for k in (1, 2, 3):
            for fn in (np.cos, np.sin):
                want = want + 2 / n * (rest @ fn(2 * np.pi * k * t / period)) * fn(2 * np.pi * k * at / period)
        np.testing.assert_allclose(got[uid], np.maximum(0, want), atol=1e-6)


def decompose(y, h):
    """Additive decomposition forecast, step by step."""
    n = len(y)
    p = min(7, n // 2) if n >= 4 else 2
    if n < 2 * p:
        return np.full(h, max(0, y[-30:].mean()))
    half = p // 2
    w = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    trend = np.full(n, np.nan)
    trend[half:n - half] = np.convolve(y, w, "valid")
    first, last = half, n - 1 - half

    def line(a, b):
        x = np.c_[np.arange(a, b), np.ones(b - a)]
        return np.linalg.lstsq(x, trend[a:b], rcond=None)[0]

    k1, c1 = line(first, min(first + p, last))
    k2, c2 = line(max(first, last - p), last)
    trend[:first] = k1 * np.arange(first) + c1
    trend[last + 1:] = k2 * np.arange(last + 1, n) + c2
    season = np.array([(y - trend)[i::p].mean() for i in range(p)])
    season -= season.mean()
    slope = np.polyfit(range(n), y, 1)[0]
    return np.maximum(0, [trend[-1] + slope * (s + 1) + season[(n + s) % p] for s in range(h)])


def test_seasonal_trend(demand):
    pdf, df = demand
    got = paths(closed_form.seasonal_trend(df, H))
    for uid, g in groups(pdf).items():
        np.testing.assert_allclose(got[uid], decompose(g["y"].to_numpy(), H), atol=1e-6, err_msg=uid)


def test_ridge(demand):
    pdf, df = demand
    got = paths(regression.ridge(df, H))
    for uid, g in groups(pdf).items():
        y, days = g["y"].to_numpy(), pd.to_datetime(g["ds"])
        n = len(y)
        if n < 4:
            np.testing.assert_allclose(got[uid], y.mean())
            continue
        lag = lambda k: np.r_[np.full(min(k, n), y.mean()), y[:-k] if n > k else []]
        x = np.column_stack([np.arange(n), days.dt.dayofweek, days.dt.month, lag(1), lag(7)]).astype(float)
        xc = x - x.mean(axis=0)
        w = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ (y - y.mean()))
        hist, want = list(y[-7:]), []
        for s in range(H):
            d = days.iloc[-1] + pd.Timedelta(days=s + 1)
            row = np.array([n + s, d.dayofweek, d.month, hist[-1], hist[-7] if len(hist) >= 7 else hist[0]], float)
            want.append(max(0, y.mean() + (row - x.mean(axis=0)) @ w))
            hist.append(want[-1])
        np.testing.assert_allclose(got[uid], want, atol=1e-6, err_msg=uid)


def test_seasonal_ar(demand):
    pdf, df = demand
    got = paths(regression.seasonal_ar(df, H))
    y = groups(pdf)["regular0"]["y"].to_numpy()
    z = y[8:] - y[7:-1] - y[1:-7] + y[:-8]
    x = np.c_[z[6:-1], z[:-7]]
    phi = np.linalg.solve(x.T @ x, x.T @ z[7:])
    path, zs = list(y), list(z)
    for _ in range(H):
        zs.append(phi @ [zs[-1], zs[-7]])
        path.append(zs[-1] + path[-1] + path[-7] - path[-8])
    np.testing.assert_allclose(got["regular0"], np.maximum(0, path[-H:]), atol=1e-6)


def test_models_by_fold_equal_models_alone(demand):
    _, df = demand
    two = df.withColumn("fold", F.lit(0)).unionByName(df.where("ds < date'2023-04-01'").withColumn("fold", F.lit(1)))
    both = closed_form.seasonal_trend(two, H, ["fold", "unique_id"])
    alone = paths(closed_form.seasonal_trend(df.where("ds < date'2023-04-01'"), H))
    got = paths(both.where("fold = 1").drop("fold"))
    for uid, p in alone.items():
        np.testing.assert_allclose(got[uid], p)


def test_tree_state_features_match_training(spark, demand):
    """The features of the day after a history equal the training features of that day."""
    _, df = demand
    day = dt.date(2023, 4, 15)
    regular = df.where("unique_id like 'regular%'")
    train = features.demand_features(regular).where(F.col("ds") == F.lit(day))
    ahead = trees.next_features(trees.histories(regular.where(F.col("ds") < F.lit(day))))
    cols = list(features.FEATURE_COLUMNS)
    a = train.orderBy("unique_id").select(*cols).toPandas().to_numpy(float)
    b = ahead.orderBy("unique_id").select(*cols).toPandas().to_numpy(float)
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_trees(demand, spark):
    _, df = demand
    regular = df.where("unique_id like 'regular%'")
    model = trees.fit(regular, iterations=3, depth=3)
    out = trees.predict(model, regular, 3).toPandas()
    assert len(out) == 9 and (out["y_hat"] >= 0).all()
    assert trees.importances(model, spark).agg(F.sum("importance")).head()[0] == pytest.approx(1.0)


def test_routing(demand):
    _, df = demand
    got = {r.unique_id: r.model for r in registry.assign(df).collect()}
    assert got["regular0"] == "lightgbm" and got["intermittent"] == "sarimax" and got["cold"] == "chronos2_zs"
    out = registry.routed_forecast(df, H, models={"lightgbm": closed_form.trend_harmonics}).select("unique_id", "model").distinct()
    assert {r.unique_id: r.model for r in out.collect()} == got


def test_user_model_in_walk_forward_and_routing(demand, monkeypatch):
    """A model of plain functions equals the built-in mean, alone, by fold and behind the router."""
    _, df = demand
    monkeypatch.setattr(registry, "_MODELS", dict(registry._MODELS))
    own = registry.series_model(lambda rows: rows["y"].tail(30).mean(), lambda level, horizon: [level] * horizon, lookback=30)
    registry.register("own_mean", own)
    want = paths(closed_form.naive(df, H))
    for uid, p in paths(registry.create("own_mean")(df, H)).items():
        np.testing.assert_allclose(p, want[uid])
    regular = df.where("unique_id like 'regular%'")
    a, b = (evaluation.walk_forward(regular, m, horizon=7, windows=2, step=20).orderBy("fold").collect() for m in (own, closed_form.naive))
    assert len(a) == len(b) == 2
    np.testing.assert_allclose([r["mape"] for r in a], [r["mape"] for r in b])
    routed = registry.routed_forecast(df, H, models={"lightgbm": own})
    got = paths(routed.where("model = 'lightgbm'").drop("model"))
    assert got and all(np.allclose(p, want[uid]) for uid, p in got.items())
    with pytest.raises(Exception, match="more than 5"):
        registry.series_model(lambda rows: 0.0, lambda m, h: [m] * h, most_rows=5)(df, H).collect()


def test_registered_feature_group(demand):
    _, df = demand
    features.register_group("weekend", lambda d: d.select("unique_id", "ds", (F.weekday("ds") >= 5).alias("weekend")))
    out = features.feature_table(df, groups=["weekend"])
    assert out.where("weekend <> (day_of_week >= 5)").count() == 0 and out.count() == df.count()
    with pytest.raises(ValueError, match="Unknown feature groups"):
        features.feature_table(df, groups=["nope"])


def test_bands_and_stale(demand):
    pdf, df = demand
    base = closed_form.naive(df, 2)
    row = registry.with_bands(base, df).where("unique_id = 'cold'").head()
    sd = groups(pdf)["cold"]["y"].std(ddof=0)
    assert row.upper - row.y_hat == pytest.approx(1.96 * sd)
    mixed = registry.stale_fallback(base, base.where("unique_id <> 'cold'"), base.where("unique_id = 'cold'"))
    assert {r.unique_id for r in mixed.where("is_stale").collect()} == {"cold"} and mixed.where("y_hat is null").count() == 0
