"""Trees grown from histograms, against a plain fit of one group at a time."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.forecasting import boosting, evaluation, trees
from shelfcast.learning import histograms
from shelfcast.operators.features import FEATURE_COLUMNS, demand_features


@pytest.fixture(scope="module")
def demand(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(4):
        for i in range(150 - 10 * s):
            day = dt.date(2023, 1, 1) + dt.timedelta(days=i)
            rows.append((f"s{s}", day, float(round(20 + 5 * s + 6 * np.sin(i / 7 * 2 * np.pi) + rng.normal(0, 2), 3))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["unique_id", "ds", "y"]), "unique_id string, ds date, y double")


def plain_trees(x, y, edges, rounds, depth, rate, allowed):
    """One group, one node at a time, on plain floats: predictions of the training rows and the splits used."""
    state, splits = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        nodes, out = [(0, np.arange(len(y)))], np.zeros(len(y))
        for _ in range(depth):
            below = []
            for node, rows in nodes:
                best = (1e-7, None)
                r = (y - state)[rows]
                for j in range(x.shape[1]) if len(rows) else ():
                    for e in edges[j] if allowed[j] else ():
                        left = x[rows, j] <= e
                        if 0 < left.sum() < len(rows):
                            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(rows)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (j, e))
                if best[1] is None:
                    below += [(2 * node + 1, rows), (2 * node + 2, rows[:0])]
                else:
                    left = x[rows, best[1][0]] <= best[1][1]
                    splits.append(best[1])
                    below += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
            nodes = below
        for _, rows in nodes:
            if len(rows):
                out[rows] = rate * (y - state)[rows].mean()
        state = state + out
    return state


def test_groups_grown_together_equal_plain_fits(demand, monkeypatch):
    monkeypatch.setattr(histograms, "STORE_EVERY", 3)
    ends = [dt.date(2023, 5, 1), dt.date(2023, 3, 20)]
    fold_rows = [{"fold": i, "train_end": e} for i, e in enumerate(ends)]
    sets = {"full": FEATURE_COLUMNS, "without lags": [c for c in FEATURE_COLUMNS if not c.startswith("lag")]}
    models = boosting.fit_folds(demand, fold_rows, sets, iterations=8, depth=3, bins=16)
    rows = demand_features(demand).dropna(subset=list(FEATURE_COLUMNS)).orderBy("unique_id", "ds").toPandas()
    for g, (fold, name) in enumerate(models.runs):
        own = rows[rows["ds"] <= ends[fold]]
        x, y = own[list(FEATURE_COLUMNS)].to_numpy(float), own["y"].to_numpy(float)
        want = plain_trees(x, y, models.trees.edges[g], 8, 3, 0.1, [c in sets[name] for c in FEATURE_COLUMNS])
        np.testing.assert_allclose(models.score(g, x), want, atol=1e-6)
        assert not models.trees.gain[g][[c not in sets[name] for c in FEATURE_COLUMNS]].any()


def test_blocks_and_workers_do_not_change_trees(demand):
    rows = demand_features(demand).dropna(subset=list(FEATURE_COLUMNS))
    x = F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS])
    out = []
    for size in (40, 10_000):
        blocks = histograms.pack(rows.repartition(3 if size == 40 else 1), x, F.col("y"), [F.lit(True)], len(FEATURE_COLUMNS), 16, block_rows=size)
        grown = histograms.grow(blocks, histograms.Squares(blocks, 0.1, 1), 4, 3)
        out.append((np.stack(grown.feature), np.stack(grown.cut), np.stack(grown.leaf)))
    assert all(np.array_equal(a, b) for a, b in zip(out[0], out[1], strict=True))


def test_state_features_match_the_other_engine(demand):
    """Features of the day after a history, in numpy and as columns."""
    state = trees.histories(demand.unionByName(demand.where("unique_id = 's0'").limit(9).withColumn("unique_id", F.lit("young"))))
    want = trees.next_features(state).orderBy("unique_id").select(*FEATURE_COLUMNS).toPandas().to_numpy(float)
    part = state.orderBy("unique_id").toPandas()
    history, size = np.zeros((len(part), trees.HISTORY)), part["history"].map(len).to_numpy()
    for i, h in enumerate(part["history"]):
        history[i, trees.HISTORY - len(h) :] = h
    got = boosting.fold_features(history, size, part["ds"].to_numpy().astype("datetime64[D]") + 1)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_recent_rows_give_the_same_errors(demand):
    from shelfcast.forecasting import closed_form

    table = evaluation.folds(demand, windows=3, step=20, horizon=7)
    short = evaluation.walk_forward_errors(demand, closed_form.naive, table, 7)
    whole = evaluation.walk_forward_errors(demand, lambda *a: closed_form.naive(*a), table, 7)
    a, b = (sorted(tuple(r) for r in df.select("fold", "unique_id", "ds", "y_hat").collect()) for df in (short, whole))
    assert len(a) == len(b) > 0 and [r[:3] for r in a] == [r[:3] for r in b]
    np.testing.assert_allclose([r[3] for r in a], [r[3] for r in b])


def test_benchmark_with_all_models(demand):
    names = ["naive_ma30", "xgboost", "lightgbm", "sarimax", "routing_ensemble"]
    errors = evaluation.fold_errors(demand, names, horizon=7, windows=2, step=20, iterations=5, depth=2)
    rows = evaluation.benchmark_table(errors).collect()
    assert {r.model for r in rows} == set(names) and [r.mape_mean for r in rows] == sorted(r.mape_mean for r in rows)
    assert errors.groupBy("model").count().where("count <> 2").count() == 0


def test_ablation_and_thresholds(demand):
    out = {r.config: r for r in evaluation.ablation(demand, iterations=4, windows=2, step=20, horizon=7, depth=2).collect()}
    assert set(out) == {"full", "without lags", "without rolling", "without calendar"} and out["full"].delta == 0 and all(r.folds == 2 for r in out.values())
    table = evaluation.threshold_sensitivity(demand, windows=2, step=20, horizon=7, iterations=4, depth=2).collect()
    assert len(table) == 7 and all(r.mape is not None for r in table)
