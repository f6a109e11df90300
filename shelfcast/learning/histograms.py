"""Boosted trees grown from histograms, for many groups of training rows at once.

Rows are binned once and packed into blocks of a few thousand. Every level of a tree is one pass over the blocks: each task
sums its rows per (group, tree node, feature, bin), the sums meet on the driver, and the driver picks all splits. A group is
a set of training rows, such as the rows before a fold's end, so all folds grow together. The sums are a table of fixed size
whatever the number of rows. They are sums of whole numbers, so any order of adding gives the same trees.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import pin

#: States of blocks that a worker remembers: they only save work, each can be rebuilt from the trees so far.
_HELD: dict[tuple[str, str], tuple[int, np.ndarray]] = {}
HELD_BYTES = 256 << 20
#: After this many trees the blocks are stored anew with their state, so that no task replays more.
STORE_EVERY = 50
#: Blocks in one task at most.
MOST_BLOCKS = 64
#: Sums of more partitions than this are added up in tasks first.
GATHER = 32


@dataclass
class Blocks:
    """Packed rows, and for each group the bin edges of each feature, the number of rows, and label statistics."""

    frame: DataFrame
    edges: list[list[np.ndarray]]
    rows: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    bins: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.edges), len(self.edges[0])


@dataclass
class Trees:
    """Trees of each group in heap order: a row goes right where its bin is above ``cut``; ``leaf`` holds what it gets."""

    edges: list[list[np.ndarray]]
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    scalars: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None

    def add(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, scalars: np.ndarray) -> None:
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(leaf)
        self.scalars.append(scalars)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        node = 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > cut[node])
    return node - ((1 << levels) - 1)


def pack(rows: DataFrame, x: Column, y: Column, groups: Sequence[Column], features: int, bins: int = 32, block_rows: int = 8_192) -> Blocks:
    """``x`` is an array of ``features`` numbers, ``y`` the label; ``groups`` are conditions that say whose training row a row is.

    Edges are quantiles of the group's own rows, by a sketch.
    """
    flat = pin(rows.select(x.alias("x"), y.cast("double").alias("y"), F.array(*groups).alias("used")), "train")
    probs = [i / bins for i in range(1, bins)]
    stats = []
    for g in range(len(groups)):
        own = F.col("used")[g]
        edge = [F.percentile_approx(F.when(own, F.col("x")[j]), probs, 10_000) for j in range(features)]
        label = F.when(own, F.col("y"))
        stats.append(F.struct(F.array(*edge).alias("edges"), F.count(label).alias("n"), F.avg(label).alias("mean"), F.max(F.abs(label)).alias("most")).alias(f"g{g}"))
    head = flat.agg(*stats, F.count(F.lit(1)).alias("total")).head()
    found = [head[f"g{g}"] for g in range(len(groups))]
    edges = [[np.unique(np.array(e if e is not None else [], float)) for e in s["edges"]] for s in found]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(parts, ignore_index=True)
            values, used = np.stack(part["x"].to_list()), np.stack(part["used"].to_list()).T
            data = np.stack([binned(values, e) for e in edges])
            one = (uuid.uuid4().hex, len(part), part["y"].to_numpy(float).tobytes(), used.astype(np.uint8).tobytes(), data.tobytes(), 0, b"")
            return pd.DataFrame([one], columns=["block", "n", "y", "used", "bins", "done", "state"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= block_rows:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    # As many tasks as run at a time, so that a pass over many blocks pays for few tasks; more where one would hold too many.
    blocks = max(1, math.ceil(head["total"] / block_rows))
    parts = max(min(blocks, 2 * rows.sparkSession.sparkContext.defaultParallelism), math.ceil(blocks / MOST_BLOCKS))
    packed = flat.repartition(parts).mapInPandas(build, "block string, n int, y binary, used binary, bins binary, done int, state binary")

    def numbers(name: str) -> np.ndarray:
        return np.array([s[name] or 0.0 for s in found], float)

    return Blocks(pin(packed, "blocks"), edges, numbers("n"), numbers("mean"), numbers("most"), bins)


class Squares:
    """Least squares: a leaf is the mean residual of its rows times the learning rate."""

    channels = 2

    def __init__(self, blocks: Blocks, rate: float, min_rows: int):
        self.rate, self.min_rows, self.base = rate, min_rows, blocks.mean
        # Residuals become whole numbers small enough for exact sums.
        room = 2.0**51 / np.maximum(blocks.rows, 1) / np.maximum(4 * blocks.most, 1e-9)
        self.scale = 2.0 ** np.floor(np.log2(room))

    def start(self, g: int, n: int) -> np.ndarray:
        return np.full(n, self.base[g])

    def measure(self, g: int, y: np.ndarray, state: np.ndarray) -> list[np.ndarray | None]:
        """Weights of each channel; None counts rows."""
        return [None, np.rint((y - state) * self.scale[g])]

    def advance(self, g: int, y: np.ndarray, state: np.ndarray, got: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        return state + got

    def gains(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Gain of splitting each node (nodes, features, bins) into sums ``left`` and ``right`` (channel first)."""
        (nl, gl), (nr, gr) = left, right
        n, g = nl + nr, gl + gr
        fits = (nl >= self.min_rows) & (nr >= self.min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(fits, gl * gl / nl + gr * gr / nr - g * g / n, -np.inf)

    def leaves(self, g: int, sums: np.ndarray) -> np.ndarray:
        n, total = sums
        return np.where(n > 0, total / np.maximum(n, 1), 0.0) / self.scale[g] * self.rate

    def settle(self, g: int, sums: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.zeros(2)


class Logistic:
    """Boosting of log odds, one class against the rest per group: a leaf is one Newton step times the learning rate."""

    channels = 3

    def __init__(self, blocks: Blocks, positive: Sequence[float], rate: float, min_rows: int = 1):
        self.positive, self.rate, self.min_rows = np.array(positive), rate, min_rows
        self.scale = 2.0 ** np.floor(np.log2(2.0**50 / np.maximum(blocks.rows, 1)))

    def start(self, g: int, n: int) -> np.ndarray:
        return np.zeros(n)

    def measure(self, g: int, y: np.ndarray, state: np.ndarray) -> list[np.ndarray | None]:
        p = 1 / (1 + np.exp(-state))
        return [None, np.rint(((y == self.positive[g]) - p) * self.scale[g]), np.rint(p * (1 - p) * self.scale[g])]

    def advance(self, g: int, y: np.ndarray, state: np.ndarray, got: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        return state + got

    def gains(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        (nl, gl, _), (nr, gr, _) = left, right
        fits = (nl >= self.min_rows) & (nr >= self.min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(fits, gl * gl / nl + gr * gr / nr - (gl + gr) ** 2 / (nl + nr), -np.inf)

    def leaves(self, g: int, sums: np.ndarray) -> np.ndarray:
        _, grad, curve = sums
        return np.where(curve > 0, grad / np.maximum(curve, 1), 0.0) * self.rate

    def settle(self, g: int, sums: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.zeros(2)


class Samme:
    """Reweighting after SAMME: a leaf is the class with the most weight; rows that a tree gets wrong weigh more."""

    def __init__(self, blocks: Blocks, classes: int):
        self.classes = self.channels = classes
        self.rows = blocks.rows
        self.scale = 2.0 ** np.floor(np.log2(2.0**50 / np.maximum(blocks.rows, 1)))
        self.live = np.ones(len(blocks.rows), bool)

    def start(self, g: int, n: int) -> np.ndarray:
        return np.ones(n)

    def measure(self, g: int, y: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        whole = np.rint(state * self.scale[g])
        return [np.where(y == c, whole, 0.0) for c in range(self.classes)]

    def advance(self, g: int, y: np.ndarray, state: np.ndarray, got: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        alpha, factor = scalars
        return state * np.where(got != y, math.exp(alpha), 1.0) * factor

    def gains(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Fall of the weighted Gini impurity."""

        def pure(x: np.ndarray) -> np.ndarray:
            total = x.sum(axis=0)
            return np.where(total > 0, (x * x).sum(axis=0) / np.maximum(total, 1), 0.0)

        fits = (left.sum(axis=0) > 0) & (right.sum(axis=0) > 0)
        return np.where(fits, pure(left) + pure(right) - pure(left + right), -np.inf)

    def leaves(self, g: int, sums: np.ndarray) -> np.ndarray:
        return sums.argmax(axis=0).astype(float)

    def settle(self, g: int, sums: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """(log odds of the tree, factor that keeps the mean weight at one); zero odds for a group that has stopped."""
        if not self.live[g]:
            return np.array([0.0, 1.0])
        total = sums.sum()
        missed = total - sums[leaf.astype(int), np.arange(len(leaf))].sum()
        error = missed / total if total else 1.0
        if error >= 1 - 1 / self.classes:
            self.live[g] = False
            return np.array([0.0, 1.0])
        self.live[g] = error > 1e-10
        error = max(error, 1e-10)
        alpha = math.log((1 - error) / error) + math.log(self.classes - 1)
        factor = self.rows[g] * self.scale[g] / (total - missed + missed * math.exp(alpha))
        return np.array([alpha, factor])


def _state(fit: str, row: dict, y: np.ndarray, bins: np.ndarray, task, past, depth: int) -> np.ndarray:
    """State of a block after the trees ``past``, from the worker's memory, the block, or the start."""
    key = (fit, row["block"])
    done, state = _HELD.get(key, (-1, None))
    if done < row["done"]:
        done = row["done"]
        groups = len(bins)
        state = np.frombuffer(row["state"], float).reshape(groups, -1).copy() if done else np.stack([task.start(g, len(y)) for g in range(groups)])
    for feature, cut, leaf, scalars in past(done):
        for g in range(len(bins)):
            state[g] = task.advance(g, y, state[g], leaf[g][walk(bins[g], feature[g], cut[g], depth)], scalars[g])
        done += 1
    if sum(s.nbytes for _, s in _HELD.values()) > HELD_BYTES:
        _HELD.clear()
    _HELD[key] = done, state
    return state


def _opened(row: dict, groups: int, features: int):
    n = row["n"]
    y, used = np.frombuffer(row["y"], float), np.frombuffer(row["used"], np.uint8).reshape(groups, n).astype(bool)
    return y, used, np.frombuffer(row["bins"], np.uint8).reshape(groups, n, features)


def grow(blocks: Blocks, task, rounds: int, depth: int, allowed: np.ndarray | None = None) -> Trees:
    """``rounds`` trees of ``depth`` for every group. ``allowed`` (group, feature) says which features a group may use.

    Of equal gains the first feature and the lowest bin win.
    """
    spark = blocks.frame.sparkSession
    groups, features = blocks.shape
    width, fit, frame = blocks.bins, uuid.uuid4().hex, blocks.frame
    open_features = np.ones((groups, features), bool) if allowed is None else allowed
    # Kept in memory where there is room; what is evicted is read again from the stored blocks.
    frame = frame.persist()
    trees = Trees(blocks.edges, depth, gain=np.zeros((groups, features)))
    shipped: list = []  # broadcast runs of trees, and the number of trees in them
    sent = 0

    def replay():
        """A function that gives the trees from a number on; old ones travel as broadcasts, new ones with the task."""
        packs, new = list(shipped), list(zip(trees.feature[sent:], trees.cut[sent:], trees.leaf[sent:], trees.scalars[sent:], strict=True))

        def past(start: int) -> Iterator:
            for first, many, pack_ in packs:
                if start < first + many:
                    yield from pack_.value[max(0, start - first) :]
            at = packs[-1][0] + packs[-1][1] if packs else 0
            yield from new[max(0, start - at) :]

        return past

    for t in range(rounds):
        feature, cut = np.full((groups, (1 << depth) - 1), -1, np.int16), np.full((groups, (1 << depth) - 1), 255, np.uint8)
        past = replay()
        for level in range(depth):
            sums = _summed(frame, fit, task, past, feature, cut, level, depth, groups, features, width)
            nodes = 1 << level
            leaf, scalars = np.zeros((groups, 2 * nodes)), np.zeros((groups, 2))
            for g in range(groups):
                h = sums[g].reshape(task.channels, nodes, features, width)
                left = h.cumsum(axis=3)
                whole = left[:, :, :, -1:]
                gain = task.gains(left, whole - left)
                gain[:, ~open_features[g]] = -np.inf
                flat = gain.reshape(nodes, -1)
                best = flat.argmax(axis=1)
                top = flat[np.arange(nodes), best]
                split = top > 1e-9 * np.maximum(1.0, np.abs(whole).max())
                at = (nodes - 1) + np.arange(nodes)
                feature[g, at] = np.where(split, best // width, -1)
                cut[g, at] = np.where(split, best % width, 255)
                np.add.at(trees.gain[g], (best // width)[split], top[split])
                if level == depth - 1:
                    f, b = np.where(split, best // width, 0), np.where(split, best % width, width - 1)
                    low = left[:, np.arange(nodes), f, b]
                    both = np.stack([low, whole[:, np.arange(nodes), f, 0] - low], axis=2).reshape(task.channels, -1)
                    leaf[g] = task.leaves(g, both)
                    scalars[g] = task.settle(g, both, leaf[g])
        trees.add(feature, cut, leaf, scalars)
        if len(trees.leaf) - sent >= 20:
            many = len(trees.leaf) - sent
            shipped.append((sent, many, spark.sparkContext.broadcast(list(zip(trees.feature[sent:], trees.cut[sent:], trees.leaf[sent:], trees.scalars[sent:], strict=True)))))
            sent += many
        if (t + 1) % STORE_EVERY == 0 and t + 1 < rounds:
            older, frame = frame, _stored(frame, fit, task, replay(), depth, groups, features, t + 1).persist()
            older.unpersist()
        if not getattr(task, "live", np.ones(1, bool)).any():
            break
    frame.unpersist()
    return trees


def _summed(frame: DataFrame, fit: str, task, past, feature, cut, level: int, depth: int, groups: int, features: int, width: int) -> np.ndarray:
    """Sums per group, channel, node, feature and bin of one level."""
    size = (1 << level) * features * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, task.channels, size))
        for batch in batches:
            for row in batch.to_pylist():
                y, used, bins = _opened(row, groups, features)
                state = _state(fit, row, y, bins, task, past, depth)
                for g in range(groups):
                    own = np.flatnonzero(used[g])
                    if not len(own):
                        continue
                    whole = len(own) == len(y)
                    mine, labels, now = (bins[g], y, state[g]) if whole else (bins[g][own], y[own], state[g][own])
                    place = walk(mine, feature[g], cut[g], level) * (features * width)
                    weights = task.measure(g, labels, now)
                    for j in range(features):
                        key = place + mine[:, j]
                        span = slice(j * width, None)
                        for c, weight in enumerate(weights):
                            got = np.bincount(key, weights=weight, minlength=size)
                            total[g, c, span] += got[: size - j * width]
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["k", "sums"])

    each = frame.select("block", "n", "y", "used", "bins", "done", "state").mapInArrow(run, "k long, sums binary")

    def added(table: pa.Table) -> pa.Table:
        out = np.zeros(groups * task.channels * size)
        for x in table.column("sums"):
            out += np.frombuffer(x.as_py(), float)
        return pa.table({"k": [0], "sums": pa.array([out.tobytes()], pa.binary())})

    if blocks_parts(frame) > GATHER:
        # A hash of the partition deals the sums over tasks, so no task adds up more than some of them.
        dealt = each.withColumn("k", F.pmod(F.spark_partition_id().cast("long"), F.lit(max(2, blocks_parts(frame) // GATHER))))
        each = dealt.groupBy("k").applyInArrow(added, "k long, sums binary")
    found = each.select("sums").collect()
    out = np.zeros(groups * task.channels * size)
    for r in found:
        out += np.frombuffer(r["sums"], float)
    return out.reshape(groups, task.channels, size)


def blocks_parts(frame: DataFrame) -> int:
    """Files of the stored blocks: an upper bound of the partitions that read them."""
    return len(frame.inputFiles())


def _stored(frame: DataFrame, fit: str, task, past, depth: int, groups: int, features: int, done: int) -> DataFrame:
    """The blocks with their state after ``done`` trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            states = []
            for row in rows:
                y, _, bins = _opened(row, groups, features)
                states.append(_state(fit, row, y, bins, task, past, depth).tobytes())
            yield batch.assign(done=done, state=states)

    return pin(frame.mapInPandas(run, frame.schema), "blocks")
