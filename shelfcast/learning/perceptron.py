"""The multilayer perceptron, its gradient summed by matrix products over packed rows.

MLlib's objective, starting weights, steps and stopping rules are kept: every stack of ``blockSize`` rows counts alike,
limited-memory BFGS takes strong Wolfe steps, and the fitted model is MLlib's own. A pass hands the tasks the weights, and one
sum per task comes back, a table of fixed size whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import pin

#: Rows of a packed piece, and rows that pass the layers at a time.
PIECE, CHUNK = 4_096, 2_048
#: Rows from which on they are packed.
FEWEST = 20_000
#: Corrections that the search remembers, and values that the stopping rule does.
MEMORY, VALUES = 10, 20

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Perceptron(MultilayerPerceptronClassifier):
    """MLlib's classifier, fitted in passes over packed rows.

    Fewer than ``FEWEST`` rows, where a pass costs little beside starting it, and any other solver than BFGS are left to MLlib.
    Both ways take the same steps but for rounding, which many steps make visible.
    """

    def _fit(self, dataset: DataFrame):
        if self.getSolver() != "l-bfgs" or dataset.limit(FEWEST).count() < FEWEST:
            return super()._fit(dataset)
        layers = list(self.getLayers())
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        packed = pin(rows.mapInPandas(packer(self.getBlockSize(), layers[-1]), "stacks long, x binary, y binary, w binary"), "perceptron")
        size = packed.agg(F.sum("stacks").alias("stacks"), F.count(F.lit(1)).alias("pieces")).head()
        if not size["pieces"]:
            return super()._fit(dataset)
        one = dataset.limit(1)
        start = self._unmoved({}, one).weights.toArray()
        # Kept in memory where there is room; what is evicted is read again from the stored pieces.
        spread = packed.repartition(min(size["pieces"], packed.sparkSession.sparkContext.defaultParallelism))
        pieces = spread.rdd.map(lambda r: (r["x"], r["y"], r["w"])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            weights = minimise(lambda w: measured(pieces, w, layers, size["stacks"]), start, self.getMaxIter(), self.getTol())
        finally:
            pieces.unpersist()
        return self._copyValues(self._unmoved({self.initialWeights: Vectors.dense(weights)}, one))

    def _unmoved(self, params: dict, rows: DataFrame):
        """MLlib's model with the weights it starts from."""
        return super(Perceptron, self.copy({self.maxIter: 0} | params))._fit(rows)


def packer(stack: int, classes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs the rows of a partition; a row weighs one part of its stack, and stacks are cut as MLlib cuts them."""
    most = max(1, PIECE // stack) * stack

    def piece(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        if not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
            raise ValueError(f"features must be finite and labels whole numbers below {classes}")
        starts = np.arange(0, len(y), stack)
        sizes = np.minimum(stack, len(y) - starts)
        row = (len(starts), x.astype(float).tobytes(), y.astype(float).tobytes(), np.repeat(1.0 / sizes, sizes).tobytes())
        return pd.DataFrame([row], columns=["stacks", "x", "y", "w"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = None, None
        for batch in batches:
            if not len(batch):
                continue
            more = np.stack(batch["x"].to_list()).astype(float), batch["y"].to_numpy(float)
            x, y = more if x is None else (np.concatenate([x, more[0]]), np.concatenate([y, more[1]]))
            while len(y) >= most:
                yield piece(x[:most], y[:most])
                x, y = x[most:], y[most:]
        if x is not None and len(y):
            yield piece(x, y)

    return run


def unpacked(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of (matrix, offsets) per layer, in MLlib's order."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def slope(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted cross-entropy of the rows and its gradient: sigmoid layers under a softmax."""
    parts, total, grad = unpacked(weights, layers), 0.0, np.zeros(len(weights))
    into = unpacked(grad, layers)
    for a in range(0, len(y), CHUNK):
        out, kind, share = [x[a : a + CHUNK]], y[a : a + CHUNK].astype(int), w[a : a + CHUNK]
        for i, (matrix, offsets) in enumerate(parts):
            z = out[-1] @ matrix
            z += offsets
            if i < len(parts) - 1:
                np.negative(z, out=z)
                with np.errstate(over="ignore"):
                    np.exp(z, out=z)
                z += 1.0
                np.reciprocal(z, out=z)
            out.append(z)
        z = out.pop()
        z -= z.max(axis=1, keepdims=True)
        each = np.arange(len(kind))
        chosen = z[each, kind].copy()
        np.exp(z, out=z)
        sums = z.sum(axis=1)
        total += float((share * (np.log(sums) - chosen)).sum())
        z /= sums[:, None]
        z[each, kind] -= 1.0
        z *= share[:, None]
        for i in range(len(parts) - 1, -1, -1):
            below = out[i]
            into[i][0][...] += below.T @ z
            into[i][1][...] += z.sum(axis=0)
            if i:
                z = z @ parts[i][0].T
                z *= below
                z *= np.subtract(1.0, below, out=below)
    return total, grad


def measured(pieces: RDD, weights: np.ndarray, layers: Sequence[int], stacks: int) -> tuple[float, np.ndarray]:
    """Mean loss over all stacks and its gradient: one pass."""

    def run(part: Iterator[tuple[bytes, bytes, bytes]]) -> Iterator[bytes]:
        total = np.zeros(len(weights) + 1)
        for x, y, w in part:
            loss, grad = slope(weights, layers, np.frombuffer(x, float).reshape(-1, layers[0]), np.frombuffer(y, float), np.frombuffer(w, float))
            total[0] += loss
            total[1:] += grad
        yield total.tobytes()

    out = np.zeros(len(weights) + 1)
    for sums in pieces.mapPartitions(run).collect():
        out += np.frombuffer(sums, float)
    return out[0] / stacks, out[1:] / stacks


class SearchFailed(Exception):
    """No step along a direction meets the Wolfe conditions."""


def _between(low: tuple, high: tuple) -> float:
    """Minimum of the cubic through two brackets (step, value, slope), kept off both ends."""
    (a, fa, da), (b, fb, db) = low, high
    with np.errstate(all="ignore"):
        first = da + db - 3 * (fa - fb) / (a - b)
        second = np.sqrt(np.float64(first * first - da * db))
        t = b - (b - a) * (db + second - first) / (db - da + 2 * second)
    lower, upper = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return lower if t < lower else upper if t > upper else float(t)


def wolfe(phi: Callable[[float], tuple], start: tuple, t: float, tries: int = 10, near: float = 1e-4, flat: float = 0.9) -> float:
    """A step along a falling direction with enough decrease and a flat enough slope. ``phi`` gives (step, value, slope)."""
    _, value, fall = low = start
    if fall > 0:
        raise SearchFailed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + near * c[0] * fall or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= flat * abs(fall):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    for i in range(tries):
        c = phi(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + near * t * fall or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= flat * abs(fall):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed


def _direction(grad: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The inverse Hessian of the last corrections times the gradient, downhill."""
    out, scale = grad.copy(), 1.0
    if steps:
        scale = steps[0] @ turns[0] / (turns[0] @ turns[0])
        if not scale >= 0:
            raise SearchFailed
    kept = []
    for s, y in zip(steps, turns, strict=True):
        rho = s @ y
        share = s @ out / rho
        if not math.isfinite(share):
            raise SearchFailed
        out -= share * y
        kept.append((share, rho))
    out *= scale
    for s, y, (share, rho) in reversed(list(zip(steps, turns, kept, strict=True))):
        out += (share - y @ out / rho) * s
    return -out


def minimise(objective: Objective, x: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Limited-memory BFGS with strong Wolfe steps. A search that fails forgets the corrections; the second in a row ends it."""
    value, grad = objective(x)
    first, past, steps, turns, failed, done = value, [math.inf], [], [], False, 0
    while done < rounds and np.linalg.norm(grad) > max(tolerance * abs(value), 1e-8):
        if len(past) >= 2 and abs(value - max(past)) <= tolerance * abs(first):
            break
        seen: dict[float, tuple[float, np.ndarray]] = {0.0: (value, grad)}

        def phi(t: float) -> tuple[float, float, float]:
            if t not in seen:
                seen[t] = objective(x + t * way)
            return t, seen[t][0], float(seen[t][1] @ way)

        try:
            with np.errstate(all="ignore"):
                way = _direction(grad, steps, turns)
            t = wolfe(phi, phi(0.0), 1.0 if done else 1.0 / np.linalg.norm(way))
            if t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, steps, turns = True, [], []
            continue
        new, (now, slope_) = x + t * way, seen[t]
        steps, turns = [new - x, *steps][:MEMORY], [slope_ - grad, *turns][:MEMORY]
        x, value, grad, failed, done = new, now, slope_, False, done + 1
        past = [*past, value][-VALUES:]
    return x
