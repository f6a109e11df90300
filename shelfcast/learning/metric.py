"""A metric index: cells around centres, with triangle bounds that leave out cells and rows before any distance is measured.

Centres are spread over a bounded sample; every row belongs to the cell of its nearest centre and knows its distance to
it. For a query at distance d from a centre, rows of that cell at distance r from the centre are at least |d - r| away. So a
query asks only cells whose range of r and whose bounding box are near enough, and of those only rows in a window of r. Cells are cut into tiles of
bounded size, so a crowded cell spreads over tasks, and a tile meets bounded batches of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import pin

#: Room for rounding in every bound.
SLACK = 1e-9


@dataclass
class Index:
    """Rows (cell, tile, r, key, x, payload), and per cell the number of rows, their range of r, their box and the tiles."""

    frame: DataFrame
    centres: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tile: int
    floor: np.ndarray | None = None
    ceiling: np.ndarray | None = None

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all centres, measured the same way everywhere."""
        out = np.empty((len(x), len(self.centres)))
        step, flat = max(1, 16_384 // len(self.centres)), np.ascontiguousarray(self.centres.T)
        room = np.empty((step, len(self.centres)))
        # A few rows at a time stay in the processor's cache; one dimension after the other, so the sum has one order.
        for a in range(0, len(x), step):
            part, into = x[a : a + step], out[a : a + step]
            into[...] = 0.0
            for j in range(x.shape[1]):
                gap = np.subtract(part[:, j, None], flat[j], out=room[: len(part)])
                gap *= gap
                into += gap
        return np.sqrt(out, out=out)

    def outside(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of each row to any row of the cell beside it, by the cell's box."""
        gap = np.maximum(np.maximum(self.floor[cell] - x, x - self.ceiling[cell]), 0.0)
        return np.sqrt((gap * gap).sum(axis=1))

    def least(self, d: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance to any row of each cell; infinite for empty cells."""
        bound = np.maximum(np.maximum(d - self.high, self.low - d), 0.0)
        return np.where(self.count > 0, bound, np.inf)

    def tiles(self) -> np.ndarray:
        return np.maximum(1, -(-self.count // self.tile))


def spread(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by farthest-first choice: each is the sampled row farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < cells and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _slices(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, 4_000_000 // max(1, width))
    for a in range(0, len(batch), step):
        yield batch.iloc[a : a + step]


def build(points: DataFrame, cells: int | None = None, sample: int = 8192, tile: int = 2048, crowded: int = 0) -> Index | None:
    """Index of ``points`` (key string, x array<double>, payload columns); None if there are none.

    Centres come from at most ``sample`` rows with the smallest hashes of the key; all rows are indexed. By default there are
    about as many cells as the root of the number of rows, half of ``sample`` at most; ``crowded`` more centres are plain sampled rows, which fall where rows are dense.
    """
    rows = pin(points, "points")
    n = rows.count()
    if not n:
        return None
    some = rows.select("x").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    centres = spread(np.array([r["x"] for r in some], float), cells or min(max(1, sample // 2), max(1, int(np.sqrt(n)))))
    centres = np.unique(np.concatenate([centres, np.array([r["x"] for r in some[:crowded]], float).reshape(-1, centres.shape[1])]), axis=0)
    made = Index(rows, centres, *[np.zeros(len(centres))] * 3, tile)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, centres.size):
                d = made.away(np.stack(part["x"].to_list()))
                yield part.assign(cell=d.argmin(axis=1).astype(np.int32), r=d.min(axis=1))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    frame_of, made.frame = made.frame, None  # the tasks need no frame
    placed = pin(frame_of.mapInPandas(place, f"{types}, cell int, r double"), "cells")
    width = centres.shape[1]
    count, low, high = (np.zeros(len(centres)), np.full(len(centres), np.inf), np.full(len(centres), -np.inf))
    made.floor, made.ceiling = np.zeros(centres.shape), np.zeros(centres.shape)
    box = [f(F.col("x")[j]) for f in (F.min, F.max) for j in range(width)]
    for s in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.array(*box).alias("box")).collect():
        count[s["cell"]], low[s["cell"]], high[s["cell"]] = s["n"], s["low"] - SLACK, s["high"] + SLACK
        made.floor[s["cell"]], made.ceiling[s["cell"]] = s["box"][:width], s["box"][width:]
    made.count, made.low, made.high = count.astype(np.int64), low, high
    parts = listed(made.tiles())
    made.frame = placed.withColumn("tile", F.pmod(F.xxhash64("key"), parts[F.col("cell")]).cast("int"))
    return made


def listed(values: np.ndarray, kind: str = "int") -> Column:
    """A constant array, one expression however long."""
    return F.expr(f"array({', '.join(map(str, values.tolist()))})").cast(f"array<{kind}>")


def meet(index: Index, requests: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, batch: int = 2048) -> DataFrame:
    """``work(queries, rows)`` for every tile and every batch of the ``requests`` (cell, key, ...) to its cell."""
    requests = pin(requests, "requests")
    asked = np.zeros(len(index.count), np.int64)
    for r in requests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[r["cell"]] = r["n"]
    batches = listed(np.maximum(1, -(-asked // batch)))
    tiles = listed(index.tiles())

    def numbers(many: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), many[F.col("cell")] - 1))

    left = requests.withColumn("batch", F.pmod(F.xxhash64("key"), batches[F.col("cell")]).cast("int")).withColumn("tile", numbers(tiles))
    wanted = listed(asked > 0, "boolean")
    right = index.frame.where(wanted[F.col("cell")]).withColumn("batch", numbers(batches))
    by = ["cell", "tile", "batch"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(work, schema)


def asking(index: Index, queries: DataFrame, cells: Callable[[np.ndarray, pd.DataFrame], np.ndarray], reach: Callable[[pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """(cell, d, columns of ``queries``): each query once for every cell that ``cells(distances, queries)`` marks.

    With ``reach``, the largest distance that matters to each query, cells whose box lies beyond it are left out.
    """
    bare = replace(index, frame=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, bare.centres.size):
                d = bare.away(np.stack(part["x"].to_list()))
                row, cell = np.nonzero(cells(d, part) & (bare.count > 0))
                if reach is not None:
                    near = bare.outside(np.stack(part["x"].to_list())[row], cell) <= reach(part)[row] * (1 + SLACK) + SLACK
                    row, cell = row[near], cell[near]
                yield part.iloc[row].assign(cell=cell.astype(np.int32), d=d[row, cell])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(run, f"{types}, cell int, d double")


def window(rows: np.ndarray, d: float, reach: float) -> slice:
    """Rows (sorted r) that may be within ``reach`` of a query at distance ``d`` from their centre."""
    room = SLACK * (1 + abs(d) + abs(reach))
    return slice(int(np.searchsorted(rows, d - reach - room, "left")), int(np.searchsorted(rows, d + reach + room, "right")))
