"""Learning operators against brute force and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast.learning import anomaly, classify, cluster, histograms, metric, multipliers, neighbours, perceptron, prepare, reduce


@pytest.fixture(scope="module")
def cloud(spark):
    """Two clear groups, one of them crowded, some exact copies and a few far points."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.3, (400, 4)), rng.normal(6, 0.5, (150, 4)), np.zeros((60, 4)), rng.uniform(20, 40, (6, 4))]
    label = np.r_[np.zeros(400), np.ones(150), np.zeros(60), np.full(6, 2.0)]
    rows = [(f"p{i:04d}", Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, label))]
    return x, label, spark.createDataFrame(rows, ["Product_ID", "features", "label"])


def test_nearest_equals_brute_force(cloud):
    x, _, df = cloud
    train, queries = df.where("Product_ID < 'p0500'"), df.where("Product_ID >= 'p0500'")
    got = {}
    for r in neighbours.nearest(train, queries, k=7).collect():
        got.setdefault(r["query"], []).append((r.distance, r.neighbour))
    assert len(got) == len(x) - 500
    for q, found in got.items():
        d = np.sqrt(((x[:500] - x[int(q[1:])]) ** 2).sum(axis=1))
        np.testing.assert_allclose(sorted(v for v, _ in found), np.sort(d)[:7], atol=1e-9)
    votes = neighbours.vote(neighbours.nearest(train, queries), queries)
    assert votes.where("prediction <> label and label < 2").count() == 0


def test_blocks_leave_no_neighbour_out(cloud):
    x, _, df = cloud
    train, queries = df.where("Product_ID < 'p0500'"), df.where("Product_ID >= 'p0500'")
    want = sorted(tuple(r) for r in neighbours.nearest(train, queries, k=7).collect())
    got = sorted(tuple(r) for r in neighbours.nearest_of_all(train, queries, k=7, block=40).collect())
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want] and len(got) == 7 * (len(x) - 500)
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_index_measures_few_pairs(spark):
    """Clustered points: at most a tenth of all distances is measured, half the growth of queries x train."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (1000, 4000):
        centre = rng.uniform(0, 100, (40, 6))
        x = centre[rng.integers(0, 40, n)] + rng.normal(0, 0.5, (n, 6))
        df = spark.createDataFrame([(f"p{i:05d}", Vectors.dense(v), 0.0) for i, v in enumerate(x)], ["Product_ID", "features", "label"])
        queries, counter = df.where("Product_ID < 'p00200'"), spark.sparkContext.accumulator(0)
        got = neighbours.nearest_of_all(df, queries, k=5, measured=counter).collect()
        shares.append(counter.value / (200 * n))
        want = np.sort(np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :5]
        for r in got:
            assert abs(r["distance"] - want[int(r["query"][1:]), r["position"] - 1]) < 1e-9
        assert len(got) == 1000
    assert max(shares) <= 0.1 and shares[1] <= shares[0] * 1.5


def test_cells_grow_with_the_rows(spark):
    """Beyond 512 cells their number still grows, and a query is handed on to few cells besides its own."""
    rng = np.random.default_rng(8)
    n = 300_000
    frame = pd.DataFrame({"key": [f"p{i:06d}" for i in range(n)], "x": list(rng.uniform(0, 1, (n, 2)))})
    points = spark.createDataFrame(frame)
    index = metric.build(points)
    assert 512 < len(index.centres) <= n**0.5 and index.count.sum() == n
    asked = metric.asking(index, points.limit(500), lambda d, part: np.isfinite(d), lambda part: np.full(len(part), 0.01))
    found = asked.collect()
    assert 500 <= len(found) <= 500 * 8
    for r in found[:200]:
        assert index.outside(np.array([r["x"]]), np.array([r["cell"]]))[0] <= 0.0101


def test_neighbours_of_awkward_tables(spark, cloud):
    _, _, df = cloud
    same = spark.createDataFrame([(f"s{i}", Vectors.dense([1.0, 1.0]), 0.0) for i in range(50)], ["Product_ID", "features", "label"])
    got = neighbours.nearest_of_all(same, same.limit(2), k=7, block=10).collect()
    assert {(r["neighbour"], r["distance"]) for r in got} == {(k, 0.0) for k in sorted(f"s{i}" for i in range(50))[:7]}
    assert neighbours.nearest_of_all(same.where("false"), same).count() == 0 and neighbours.nearest_of_all(same, same.where("false")).count() == 0
    assert len(neighbours.nearest_of_all(same.where("Product_ID < 's1'"), same.limit(3), k=7).collect()) == 3


def brute_density(x, eps, min_points):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= min_points
    root = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if root[i] < 0:
            queue = [i]
            root[i] = i
            while queue:
                for j in np.flatnonzero(near[queue.pop()] & core & (root < 0)):
                    root[j] = i
                    queue.append(j)
    for i in np.flatnonzero(~core):
        own = [root[j] for j in np.flatnonzero(near[i] & core)]
        root[i] = min(own) if own else -1
    return root


def test_density_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 1, (900, 11)), rng.normal(5, 0.8, (600, 11)), rng.uniform(-8, 12, (400, 11)), np.zeros((100, 11))]
    rows = [(f"p{i:05d}", Vectors.dense(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["Product_ID", "features"])
    got = {r["Product_ID"]: r["cluster"] for r in cluster.density_clusters(df, tile=300).collect()}
    want = brute_density(x, 2.5, 10)
    names = {}
    for i, w in enumerate(want):
        c = got[f"p{i:05d}"]
        assert (c == -1) == (w == -1)
        if w >= 0:
            assert names.setdefault(c, w) == w
    assert len(set(names.values())) == len(names) > 1 and (want == -1).any()


def test_dense_balls_ask_few_cells(spark, monkeypatch):
    """Crowds, a bridge between two of them, thin spots and noise: brute force's clusters, without asking around for each point."""
    rng = np.random.default_rng(13)
    crowds = [rng.normal(c, 0.25, (900, 3)) for c in (0.0, 6.0, 14.0)]
    bridge = np.linspace([1.0] * 3, [5.0] * 3, 25) + rng.normal(0, 0.05, (25, 3))
    x = np.r_[crowds[0], crowds[1], crowds[2], bridge, rng.uniform(-6, 20, (250, 3)), np.repeat([[19.0, -5.0, 3.0]], 12, axis=0)]
    df = spark.createDataFrame([(f"p{i:05d}", Vectors.dense(v)) for i, v in enumerate(x)], ["Product_ID", "features"])
    asked, plain = [], cluster.meet
    monkeypatch.setattr(cluster, "meet", lambda index, requests, *a: (asked.append(requests.count()), plain(index, requests, *a))[1])
    got = {r["Product_ID"]: r["cluster"] for r in cluster.density_clusters(df, eps=0.9, min_points=8, tile=400).collect()}
    want, names = brute_density(x, 0.9, 8), {}
    for i, w in enumerate(want):
        c = got[f"p{i:05d}"]
        assert (c == -1) == (w == -1) and (w == -1 or names.setdefault(w, c) == c)
    assert len(set(names.values())) == len(names) > 1 and (want == -1).any()
    assert sum(asked) <= 1.5 * len(x)


def test_density_clusters(cloud):
    _, label, df = cloud
    out = {r.Product_ID: r.cluster for r in cluster.density_clusters(df, eps=2.0, min_points=10).collect()}
    assert len(out) == len(label)
    first, second = ({out[f"p{i:04d}"] for i in np.flatnonzero(label == c)} for c in (0, 1))
    main = max(first, key=lambda c: sum(v == c for v in out.values()))
    other = max(second, key=lambda c: sum(v == c for v in out.values()))
    assert main != other and main >= 0 and other >= 0
    noise = [out[f"p{i:04d}"] for i in np.flatnonzero(label == 2)]
    assert set(noise) == {-1}


def test_isolation_ranks_far_points_first(cloud):
    _, label, df = cloud
    scores = anomaly.isolation_scores(df, anomaly.grow_forest(df, trees=40))
    top = [int(r.Product_ID[1:]) for r in scores.orderBy(F.col("score").desc()).limit(6).collect()]
    assert all(label[i] == 2 for i in top)
    assert scores.where("score <= 0 or score > 1").count() == 0


def test_flags_take_the_top_share(cloud):
    _, _, df = cloud
    scores = anomaly.isolation_scores(df, anomaly.grow_forest(df, trees=20))
    flagged = anomaly.flag_top(scores, "score", 0.05, "odd")
    assert 0 < flagged.where("odd").count() <= 0.05 * df.count() + 1


def test_reconstruction_error_matches_projection(cloud):
    x, _, df = cloud
    centred = x - x.mean(axis=0)
    base = df.sparkSession.createDataFrame([(f"p{i}", Vectors.dense(v)) for i, v in enumerate(centred)], ["Product_ID", "features"])
    got = {r.Product_ID: r.error for r in reduce.reconstruction_error(reduce.fit(base, 2), base).collect()}
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = ((centred - centred @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    np.testing.assert_allclose([got[f"p{i}"] for i in range(len(x))], want, atol=1e-8)


def test_loadings_of_either_sign(spark):
    """The component's sign is turned so that its largest weight is positive, whichever sign the fit gives."""
    rng = np.random.default_rng(4)
    for turn in (1.0, -1.0):
        base = rng.normal(0, 1, 300)
        x = np.c_[turn * 3 * base, 2 * rng.normal(0, 1, 300), -turn * base + rng.normal(0, 0.1, 300)]
        for order in ([0, 1, 2], [2, 1, 0]):
            df = spark.createDataFrame([(Vectors.dense(v),) for v in x[:, order]], ["features"])
            got = {r.feature: (r.pc1, r.pc2) for r in reduce.loadings(df, names=("a", "b", "c")).collect()}
            weights = np.array([got[n] for n in "abc"])
            _, _, vt = np.linalg.svd(x[:, order] - x.mean(axis=0)[order], full_matrices=False)
            np.testing.assert_allclose(np.abs(weights), np.abs(vt[:2].T), atol=1e-8)
            assert (weights[np.abs(weights).argmax(axis=0), [0, 1]] > 0).all()


def plain_samme(x, y, edges, rounds, classes):
    """Stumps one by one on plain floats: (feature, edge number, classes of both sides, log odds)."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for b, e in enumerate(edges[j]):
                sides = [np.array([w[m & (y == c)].sum() for c in range(classes)]) for m in (x[:, j] <= e, x[:, j] > e)]
                if min(s.sum() for s in sides) > 0:
                    pure = sum((s**2).sum() / s.sum() for s in sides)
                    if best is None or pure > best[0] * (1 + 1e-9):
                        best = (pure, j, b, sides[0].argmax(), sides[1].argmax())
        _, j, b, low, high = best
        miss = np.where(x[:, j] <= edges[j][b], low, high) != y
        error = w[miss].sum() / w.sum()
        if error >= 1 - 1 / classes:
            break
        alpha = np.log((1 - error) / max(error, 1e-10)) + np.log(classes - 1)
        out.append((j, b, low, high, alpha))
        w = w * np.exp(alpha * miss)
        w *= len(y) / w.sum()
    return out


def test_samme_equals_plain_stumps_in_every_fold(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (400, 4)), 3)
    y = np.digitize(x[:, 0] + 0.7 * x[:, 1] + rng.normal(0, 0.4, 400), [-0.5, 0.6])
    df = spark.createDataFrame([(Vectors.dense(v), float(c), i % 3) for i, (v, c) in enumerate(zip(x, y))], ["features", "label", "fold"])
    models = classify.SteppedTrees(rounds=12).fit_groups(df, [F.col("fold") != k for k in range(3)])
    for k, model in enumerate(models):
        own = np.arange(400) % 3 != k
        cells = dict(zip(model.vote.__code__.co_freevars, [c.cell_contents for c in model.vote.__closure__]))
        want = plain_samme(x[own], y[own], cells["edges"], 12, 3)
        got = [(int(f[0]), int(c[0]), int(v[0]), int(v[1]), a) for f, c, v, a in cells["members"]]
        assert [g[:4] for g in got] == [w[:4] for w in want]
        np.testing.assert_allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


def test_nine_models_cross_validated(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (240, len(prepare.CLASSIFICATION_FEATURES)))
    y = np.digitize(x[:, 0] - x[:, 2], [-0.6, 0.6])
    rows = [(f"k{i:03d}", Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, y))]
    train, test = prepare.train_test(spark.createDataFrame(rows, ["Product_ID", "raw_features", "label"]))
    models = classify.classifiers()
    models["MLP (ANN)"] = models["MLP (ANN)"].copy({models["MLP (ANN)"].maxIter: 30})
    table = {r["model"]: r for r in classify.cross_validate(train, models, folds=2).collect()}
    assert set(table) == set(models) and all(0.4 < r["cv_mean"] <= 1 and r["cv_std"] >= 0 for r in table.values())
    scores = {r["model"]: r["accuracy"] for r in classify.compare(train, test, models).collect()}
    assert set(scores) == set(models) and scores["Gradient Boosting"] > 0.6 and scores["AdaBoost"] > 0.6


def test_perceptron_walks_as_the_library_does(spark, monkeypatch):
    """Packed passes take MLlib's steps, with a short last stack and several partitions."""
    monkeypatch.setattr(perceptron, "FEWEST", 1)
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (700, 4))
    y = np.digitize(x[:, 0] * x[:, 1] + x[:, 2], [-0.7, 0.7])
    df = spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, y)], ["features", "label"]).repartition(3).localCheckpoint()
    for rounds in (0, 1, 25):
        settings = dict(layers=[4, 9, 5, 3], maxIter=rounds, seed=7)
        want, got = MultilayerPerceptronClassifier(**settings).fit(df), perceptron.Perceptron(**settings).fit(df)
        np.testing.assert_allclose(got.weights.toArray(), want.weights.toArray(), rtol=1e-5, atol=1e-6)
    assert got.transform(df).where("prediction = label").count() > 550
    far = spark.createDataFrame([(Vectors.dense([1.0] * 4), 3.0)], ["features", "label"])
    with pytest.raises(Exception, match="below 3"):
        perceptron.Perceptron(**settings).fit(df.unionByName(far))


def test_tree_passes_take_few_tasks(spark):
    """Many blocks are dealt over as many tasks as run at a time, and give the trees that one block gives."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (3000, 3)), 2)
    y = np.digitize(x[:, 0] + x[:, 1], [-0.5, 0.6])
    rows = spark.createDataFrame([(v.tolist(), float(c), i % 2) for i, (v, c) in enumerate(zip(x, y))], ["x", "y", "fold"])
    found = []
    for block_rows in (20, 10_000):
        blocks = histograms.pack(rows, F.col("x"), F.col("y"), [F.lit(True), F.col("fold") == 1], 3, block_rows=block_rows)
        assert histograms.blocks_parts(blocks.frame) <= 2 * spark.sparkContext.defaultParallelism
        found.append(histograms.grow(blocks, histograms.Logistic(blocks, [0, 1], 0.1), 4, 3))
    for a, b in zip(found[0].leaf, found[1].leaf):
        np.testing.assert_array_equal(a, b)


def test_stumps_learn(cloud):
    _, _, df = cloud
    model = classify.SteppedTrees(rounds=6, depth=2).fit(df)
    out = model.transform(df)
    assert out.where("prediction = label").count() / df.count() > 0.95


def test_no_leak():
    assert not {"Stock_Status", "Stock_Status_Enc", "Inventory_Value", "Reorder_Point"} & set(prepare.CLASSIFICATION_FEATURES)
    assert "Inventory_Value" not in prepare.REGRESSION_FEATURES


def test_scaler_sees_training_rows_only(spark):
    rows = spark.createDataFrame([(f"k{i}", Vectors.dense([float(i)]), 0.0) for i in range(200)], ["Product_ID", "raw_features", "label"])
    train, test = prepare.train_test(rows)
    assert train.count() + test.count() == 200 and 20 <= test.count() <= 60
    mean = prepare.scaled(None).fit(train).stages[0].mean[0]
    assert mean == pytest.approx(np.mean([int(r.Product_ID[1:]) for r in train.collect()]))


def test_multiplier_closed_form_beats_grid(spark):
    rows = [("a", 10.0, 5.0, 20.0, 8.0, 3), ("b", 1.0, 2.0, 50.0, 2.0, 4), ("c", 100.0, 1.0, 10.0, 30.0, 2), ("d", 5.0, 1.0, 0.0, 3.0, 1)]
    means = spark.createDataFrame(rows, "Category string, demand double, cost double, safety double, lead double, skus long")
    best = {r.Category: r for r in multipliers.best_multipliers(means).collect()}
    grid = {r.Category: r for r in multipliers.grid_multipliers(means).collect()}
    for c in best:
        assert best[c].optimal_cost <= grid[c].optimal_cost + 1e-9
        assert 0.5 <= best[c].multiplier <= 3.0
    assert best["a"].multiplier == pytest.approx(2.0) and best["b"].multiplier == 0.5 and best["c"].multiplier == 3.0
