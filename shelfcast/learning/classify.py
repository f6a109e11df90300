"""Stock-status classifiers, their cross-validation, confusion and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.learning import neighbours
from shelfcast.learning.histograms import Logistic, Samme, binned, grow, pack, walk
from shelfcast.learning.perceptron import Perceptron
from shelfcast.learning.prepare import CLASSIFICATION_FEATURES, scaled
from shelfcast.session import pin


#: Independent fits that are submitted at the same time.
PARALLEL = 4


def classifiers(n_features: int = len(CLASSIFICATION_FEATURES), n_classes: int = 3) -> dict:
    """All models of the comparison by name."""
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000),
        "Decision Tree": DecisionTreeClassifier(maxDepth=10, seed=42),
        "Random Forest": RandomForestClassifier(numTrees=100, seed=42),
        "SVM": OneVsRest(classifier=LinearSVC(maxIter=100)),
        "Naive Bayes": NaiveBayes(modelType="gaussian"),
        "Gradient Boosting": GradientTrees(classes=n_classes),
        "MLP (ANN)": Perceptron(layers=[n_features, 128, 64, n_classes], maxIter=300, seed=42),
        "KNN": Neighbours(),
        "AdaBoost": SteppedTrees(classes=n_classes),
    }


class Neighbours:
    """k nearest neighbours as a model: the labelled rows are held, and unlabelled ones vote by them."""

    def __init__(self, k: int = 7):
        self.k, self.train = k, None

    def fit(self, train: DataFrame) -> Neighbours:
        self.train = train
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return neighbours.vote(neighbours.nearest(self.train, df, k=self.k), df)


class HistogramTrees:
    """Boosted trees that all training sets of a comparison grow in the same passes over binned rows."""

    def __init__(self, rounds: int, depth: int, classes: int):
        self.rounds, self.depth, self.classes = rounds, depth, classes
        self.vote: Callable[[np.ndarray], np.ndarray] | None = None
        self.gain: np.ndarray | None = None

    def grown(self, rows: DataFrame, groups: Sequence[Column], features: int) -> list[tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]]:
        """For each group a function from feature rows to classes, and the gain of each feature."""
        raise NotImplementedError

    def fit_groups(self, rows: DataFrame, groups: Sequence[Column]) -> list[HistogramTrees]:
        """A fitted copy for the rows that meet each condition; ``rows`` has features and label."""
        features = len(rows.select("features").head()[0])
        out = []
        for vote, gain in self.grown(rows, groups, features):
            model = type(self)(rounds=self.rounds, depth=self.depth, classes=self.classes)
            model.vote, model.gain = vote, gain
            out.append(model)
        return out

    def fit(self, train: DataFrame) -> HistogramTrees:
        return self.fit_groups(train, [F.lit(True)])[0]

    def transform(self, df: DataFrame) -> DataFrame:
        vote = self.vote

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(vote(np.stack(x.to_list())) if len(x) else np.empty(0))

        return df.withColumn("prediction", predict(vector_to_array("features")))


class SteppedTrees(HistogramTrees):
    """Boosted trees after SAMME: reweight the rows a small tree gets wrong, vote by the trees' log odds."""

    def __init__(self, rounds: int = 100, depth: int = 1, classes: int = 3):
        super().__init__(rounds, depth, classes)

    def grown(self, rows, groups, features):
        blocks = pack(rows, vector_to_array("features"), F.col("label"), groups, features)
        trees = grow(blocks, Samme(blocks, self.classes), self.rounds, self.depth)
        depth, classes = self.depth, self.classes

        def voter(g: int):
            edges = blocks.edges[g]
            members = [(f[g], c[g], v[g], s[g, 0]) for f, c, v, s in zip(trees.feature, trees.cut, trees.leaf, trees.scalars, strict=True) if s[g, 0] > 0]

            def vote(x: np.ndarray) -> np.ndarray:
                bins, odds = binned(x, edges), np.zeros((len(x), classes))
                for feature, cut, leaf, alpha in members:
                    odds[np.arange(len(x)), leaf[walk(bins, feature, cut, depth)].astype(int)] += alpha
                return odds.argmax(axis=1).astype(float)

            return vote

        return [(voter(g), trees.gain[g]) for g in range(len(groups))]


class GradientTrees(HistogramTrees):
    """Gradient boosting of each class against the rest; the class with the highest log odds wins."""

    def __init__(self, rounds: int = 100, depth: int = 3, classes: int = 3, rate: float = 0.1):
        super().__init__(rounds, depth, classes)
        self.rate = rate

    def grown(self, rows, groups, features):
        each = [g for g in groups for _ in range(self.classes)]
        blocks = pack(rows, vector_to_array("features"), F.col("label"), each, features)
        trees = grow(blocks, Logistic(blocks, list(range(self.classes)) * len(groups), self.rate), self.rounds, self.depth)
        depth, classes = self.depth, self.classes

        def voter(first: int):
            edges = blocks.edges[first]
            members = [(f[first : first + classes], c[first : first + classes], v[first : first + classes]) for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True)]

            def vote(x: np.ndarray) -> np.ndarray:
                bins, odds = binned(x, edges), np.zeros((len(x), classes))
                for feature, cut, leaf in members:
                    for c in range(classes):
                        odds[:, c] += leaf[c][walk(bins, feature[c], cut[c], depth)]
                return odds.argmax(axis=1).astype(float)

            return vote

        return [(voter(g * classes), trees.gain[g * classes : (g + 1) * classes].sum(axis=0)) for g in range(len(groups))]


def fit_scaled(estimator, train: DataFrame):
    """A function from rows to rows with predictions: scaler and model fitted on ``train``."""
    if isinstance(estimator, (Neighbours, HistogramTrees)):
        scaler = scaled(None).fit(train)
        model = estimator.fit(scaler.transform(train))
        return lambda df: model.transform(scaler.transform(df))
    return scaled(estimator).fit(train).transform


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg((F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0))).alias("accuracy"))


def side_by_side(jobs: Sequence[Callable[[], object]]) -> list:
    """Results of independent jobs, some of them submitted at the same time."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(lambda job: job(), jobs))


def predictions(train: DataFrame, test: DataFrame, models: dict) -> DataFrame:
    """(model, label, prediction) of the test rows by every model, stored once. The scaler sees training rows only."""
    scaler = scaled(None).fit(train)
    fit_on, asked = (pin(scaler.transform(df).select("Product_ID", "features", "label"), "scaled") for df in (train, test))

    def job(name: str, estimator):
        def run() -> DataFrame:
            out = estimator.fit(fit_on).transform(asked)
            return pin(out.select(F.lit(name).alias("model"), "label", "prediction"), "predicted")

        return run

    parts = side_by_side([job(n, e) for n, e in models.items()])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def accuracies(predicted: DataFrame) -> DataFrame:
    """Accuracy of each model of ``predictions``."""
    return predicted.groupBy("model").agg(F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))


def compare(train: DataFrame, test: DataFrame, models: dict) -> DataFrame:
    """Test accuracy of each model, one row per model."""
    return accuracies(predictions(train, test, models))


def cross_validate(train: DataFrame, models: dict, folds: int = 5) -> DataFrame:
    """Mean and spread of accuracy over hash folds; the scaler is refitted inside each fold.

    Scaled rows are stored once per fold. Boosted trees grow for all folds in the same passes (scaling does not move their
    splits), the other fits are independent and submitted side by side.
    """
    columns = ("Product_ID", "features", "label", "fold")
    prepared = side_by_side([
        (lambda k=k: pin(scaled(None).fit(train.where(F.col("fold") != k)).transform(train).select(*columns), "scaled")) for k in range(folds)
    ])
    raw = pin(train.select("Product_ID", F.col("raw_features").alias("features"), "label", "fold"), "raw-rows")

    def scored(name: str, k: int, model, rows: DataFrame) -> tuple[str, int, float]:
        value = accuracy(model.transform(rows.where(F.col("fold") == k))).head()[0]
        return name, k, None if value is None else float(value)

    def fold_job(name: str, estimator, k: int):
        def run() -> list:
            rows = prepared[k]
            own = Neighbours(estimator.k) if isinstance(estimator, Neighbours) else estimator.copy()
            return [scored(name, k, own.fit(rows.where(F.col("fold") != k)), rows)]

        return run

    def trees_job(name: str, estimator: HistogramTrees):
        return lambda: [scored(name, k, m, raw) for k, m in enumerate(estimator.fit_groups(raw, [F.col("fold") != k for k in range(folds)]))]

    jobs = [trees_job(n, e) for n, e in models.items() if isinstance(e, HistogramTrees)]
    jobs += [fold_job(n, e, k) for n, e in models.items() if not isinstance(e, HistogramTrees) for k in range(folds)]
    rows = [r for part in side_by_side(jobs) for r in part]
    table = train.sparkSession.createDataFrame(rows, "model string, fold int, accuracy double")
    return table.groupBy("model").agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and row percent per (label, prediction)."""
    cells = predicted.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*by, "label").agg(F.sum("n").alias("total"))
    return cells.join(rows, [*by, "label"]).select(*by, "label", "prediction", "n", (F.col("n") / F.col("total") * 100).alias("row_pct"))


def importances(fitted, spark, features: Sequence[str] = CLASSIFICATION_FEATURES) -> DataFrame:
    """Importance per feature: split gains of trees, mean size of coefficients of linear models."""
    model = fitted.stages[-1] if hasattr(fitted, "stages") else fitted
    if isinstance(model, HistogramTrees):
        values = model.gain / model.gain.sum() if model.gain.sum() else model.gain
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        parts = [m.featureImportances.toArray() for m in model.models]
        values = sum(parts) / len(parts)
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")
