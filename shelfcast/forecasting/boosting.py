"""Boosted trees on lag features for all folds and feature sets of an evaluation at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.forecasting.trees import HISTORY
from shelfcast.learning.histograms import Squares, Trees, binned, grow, pack, walk
from shelfcast.operators.features import FEATURE_COLUMNS, demand_features
from shelfcast.session import pin


@dataclass
class Ensembles:
    """Boosted trees per (fold, feature set), in the order of ``runs``."""

    runs: list[tuple[int, str]]
    trees: Trees
    base: np.ndarray

    def score(self, g: int, x: np.ndarray, iterations: int | None = None) -> np.ndarray:
        bins = binned(x, self.trees.edges[g])
        out = np.full(len(x), self.base[g])
        for feature, cut, leaf in zip(self.trees.feature[:iterations], self.trees.cut, self.trees.leaf, strict=False):
            out += leaf[g][walk(bins, feature[g], cut[g], self.trees.depth)]
        return out


def fit_folds(
    demand: DataFrame, fold_rows: Sequence, feature_sets: dict[str, Sequence[str]] | None = None, iterations: int = 300,
    depth: int = 5, rate: float = 0.1, bins: int = 32, min_rows: int = 1,
) -> Ensembles:
    """Trees on the rows up to ``train_end`` of each row of the fold table, once per feature set; all grow in the same passes."""
    sets = feature_sets or {"full": FEATURE_COLUMNS}
    runs = [(int(f["fold"]), name) for f in fold_rows for name in sets]
    ends = {int(f["fold"]): f["train_end"] for f in fold_rows}
    rows = demand_features(demand).dropna(subset=list(FEATURE_COLUMNS))
    x = F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS])
    blocks = pack(rows, x, F.col("y"), [F.col("ds") <= F.lit(ends[fold]) for fold, _ in runs], len(FEATURE_COLUMNS), bins)
    allowed = np.array([[c in sets[name] for c in FEATURE_COLUMNS] for _, name in runs])
    task = Squares(blocks, rate, min_rows)
    return Ensembles(runs, grow(blocks, task, iterations, depth, allowed), blocks.mean)


def recent(demand: DataFrame, folds: Column, days: int, key: str = "unique_id") -> DataFrame:
    """(fold, key, ds, y): the last ``days`` rows of each series up to each fold's end; nothing older is copied.

    ``folds`` is the fold table as one array.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ds"))
    numbered = pin(demand.select(key, "ds", F.col("y").cast("double").alias("y"), nth.alias("nth")), "numbered")
    each = numbered.select(key, "ds", "nth", F.explode(folds).alias("f")).where(F.col("ds") <= F.col("f.train_end"))
    last = each.groupBy(key, F.col("f.fold").alias("fold")).agg(F.max("nth").alias("last"))
    near = numbered.join(last, key).where((F.col("nth") <= F.col("last")) & (F.col("nth") > F.col("last") - days))
    return near.select("fold", key, "ds", "y")


def histories(demand: DataFrame, folds: Column) -> DataFrame:
    """(fold, unique_id, ds, history): the last day of each series in each fold and its last HISTORY values, oldest first."""
    return recent(demand, folds, HISTORY).groupBy("fold", "unique_id").agg(
        F.max("ds").alias("ds"), F.expr("transform(array_sort(collect_list(struct(ds, y))), x -> x.y)").alias("history")
    )


def fold_features(history: np.ndarray, size: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Features of ``day`` for each row of ``history`` (last HISTORY values, right-aligned, ``size`` of them known)."""
    rows = np.arange(len(history))
    known = np.arange(HISTORY)[None, :] >= HISTORY - size[:, None]

    def lag(n: int) -> np.ndarray:
        return history[rows, np.where(size >= n, HISTORY - n, HISTORY - 1)]

    def last(n: int) -> np.ndarray:
        """Mask of the last n values, or of all if there are fewer."""
        return np.where((size >= n)[:, None], np.arange(HISTORY)[None, :] >= HISTORY - n, known)

    def mean(mask: np.ndarray) -> np.ndarray:
        return np.where(mask, history, 0.0).sum(axis=1) / mask.sum(axis=1)

    week = last(7)
    middle, count = mean(week), week.sum(axis=1)
    spread = np.sqrt(np.where(week, (history - middle[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(count - 1, 1))
    month = day.astype("datetime64[M]")
    return np.stack([
        lag(1), lag(7), lag(14), lag(28), middle, np.where(count > 1, spread, 0.0), mean(last(28)),
        (day.astype("datetime64[D]").astype(np.int64) + 3) % 7, month.astype(np.int64) % 12 + 1,
        (day.astype("datetime64[D]") - day.astype("datetime64[Y]")).astype(np.int64) + 1,
    ], axis=1).astype(float)


def predict_folds(models: Ensembles, histories: DataFrame, horizon: int, presets: dict[str, int]) -> DataFrame:
    """(model, config, fold, unique_id, ds, y_hat): recursive forecasts of every run.

    ``histories`` holds (fold, unique_id, ds, history), one row per series and fold: the last day and up to HISTORY values,
    oldest first. ``presets`` maps a model's name to its number of trees. Series are forecast side by side, day after day.
    """
    shared = histories.sparkSession.sparkContext.broadcast(models)
    of_fold = {}
    for g, (fold, name) in enumerate(models.runs):
        of_fold.setdefault(fold, []).append((g, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                n = len(part)
                first, size = np.zeros((n, HISTORY)), np.minimum([len(h) for h in part["history"]], HISTORY)
                for i, h in enumerate(part["history"]):
                    first[i, HISTORY - size[i] :] = h[-HISTORY:]
                start = part["ds"].to_numpy().astype("datetime64[D]")
                for g, name in of_fold.get(int(fold), ()):
                    for model, iterations in presets.items():
                        history, known, path = first.copy(), size.copy(), []
                        for step in range(1, horizon + 1):
                            x = fold_features(history, known, start + step)
                            y_hat = np.maximum(0.0, fitted.score(g, x, iterations))
                            history = np.concatenate([history[:, 1:], y_hat[:, None]], axis=1)
                            known = np.minimum(known + 1, HISTORY)
                            path.append(y_hat)
                        days = (start[:, None] + np.arange(1, horizon + 1)[None, :]).ravel()
                        yield pd.DataFrame({
                            "model": model, "config": name, "fold": fold, "unique_id": np.repeat(part["unique_id"].to_numpy(), horizon),
                            "ds": pd.Series(days.astype("datetime64[ns]")).dt.date, "y_hat": np.stack(path, axis=1).ravel(),
                        })

    return histories.mapInPandas(run, "model string, config string, fold int, unique_id string, ds date, y_hat double")
