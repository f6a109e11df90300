"""Building blocks that stay distributed however large or skewed the data is.

* ``running_totals`` is a global cumulative sum without a single-task window.
* ``mid_ranks`` ranks distinct values, so a value held by a third of all rows is one row.
* ``exact_quantiles`` uses a bounded sketch to fence off the wanted ranks and counts exactly inside the fence.
* ``scalars`` attaches one-row aggregates as scalar subqueries instead of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.session import pin


def scalars(df: DataFrame, **aggregates: Column) -> dict[str, Column]:
    """Aggregate ``df`` to one row and give each value as a column usable on any other frame."""
    row = df.agg(F.struct(*[c.alias(name) for name, c in aggregates.items()]).alias("row")).scalar()
    return {name: row.getField(name) for name in aggregates}


def slice_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: dict[str, Column],
    by: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add cumulative sums of ``totals`` in the given order, inside each group of ``by``.

    Rows are range-partitioned, so even one group holding most rows, or one value holding most of a group,
    spreads over all slices. Each slice is summed alone; a slice then only needs the total of the slices before
    it. The slice number must not change between the two reads, so the sorted rows are pinned first. The offset
    table has at most one row per slice: only the group that straddles a slice border has an offset.
    """
    by = list(by)
    work = df
    for name, value in totals.items():
        work = work.withColumn(f"__{name}", value)
    slices = slice_count(df)
    keys = [F.col(c) for c in by]
    sliced = work.repartitionByRange(slices, *keys, *order_by).withColumn("__slice", F.spark_partition_id())
    pinned = pin(sliced, "sorted")

    part = pinned.groupBy("__slice", *by).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in totals])
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        "__slice",
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.row_number().over(Window.partitionBy(*by).orderBy("__slice")).alias("__nth"),
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in totals],
    ).where(F.col("__nth") > 1).drop("__nth")

    same = pinned["__slice"] == offsets["__slice"]
    for c in by:
        same = same & pinned[c].eqNullSafe(offsets[f"__by_{c}"])
    frame = Window.partitionBy("__slice", *by).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    # At most one offset row per slice, so the broadcast is bounded by the number of shuffle partitions.
    joined = pinned.join(F.broadcast(offsets), same, "left").drop(offsets["__slice"])
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(f"__{n}").over(frame), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
    )


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = (), **extra: Column) -> DataFrame:
    """Distinct non-null values with their counts; partial aggregation collapses hot values before the shuffle."""
    extras = extra or {}
    return (
        df.select(*by, value.alias("value"), *[c.alias(n) for n, c in extras.items()])
        .where(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in extras])
    )


def mid_ranks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value, from a (value, n) table."""
    out = running_totals(counts, [F.col("value")], {"upto": F.col("n")}, by=by)
    return out.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)


def exact_quantiles(
    df: DataFrame,
    value: Column,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    level: Callable[[float, Column], Column] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group (or one row in all).

    ``level`` may move a probability by less than two ranks depending on the number of values.

    A sketch of bounded size gives fences around every wanted rank. Values outside the fences only count, values
    inside keep their identity, so the second aggregation shuffles a sliver of the data. The fences are the only table
    that is written: they tell how many cells a group can have. Few cells are walked in one row per group; many are summed
    up by ``running_totals``, so one group with most of them spreads over tasks. A rank outside its fence, which the
    sketch's error bound rules out, ends the query with an error instead of a wrong value.
    """
    by = list(by)
    probs = list(probabilities.items())
    accuracy, slack = (10_000, 5e-4) if by else (50_000, 1e-4)
    src = df.select(*by, value.cast("double").alias("v")).where(F.col("v").isNotNull())
    for c in by:
        src = src.where(F.col(c).isNotNull())
    marks = [m for _, p in probs for m in (max(0.0, p - slack), min(1.0, p + slack))]
    # Few values: no fence, the group is bounded anyway. Many: every fence spans at least five ranks on each side.
    open_fence = F.array(*[F.lit(m).cast("double") for _ in probs for m in ("-Infinity", "Infinity")])
    small = int(5 / slack)
    sketch = F.when(F.count(F.lit(1)) <= small, open_fence).otherwise(F.percentile_approx("v", marks, accuracy))
    fences = pin(src.groupBy(*by).agg(sketch.alias("f"), F.count(F.lit(1)).alias("n")), "fences")
    most = fences.agg(F.max("n")).head()[0] or 0
    fenced = src.join(fences.drop("n"), by) if by else src.withColumn("f", scalars(fences, f=F.first("f"))["f"])
    fence = F.col("f")

    inside, below = F.lit(False), []
    for i in range(len(probs)):
        lo, hi = fence.getItem(2 * i), fence.getItem(2 * i + 1)
        inside = inside | F.col("v").between(lo, hi)
        below.append(F.when(hi < F.col("v"), hi))
    under = F.coalesce(F.greatest(*below) if len(below) > 1 else below[0], F.lit(float("-inf")))
    cells = fenced.select(*by, F.when(inside, F.col("v")).otherwise(under).alias("at"), F.when(inside, 0).otherwise(1).alias("gap"))
    cells = cells.groupBy(*by, "at", "gap").agg(F.count(F.lit(1)).alias("c"))
    packed = most <= small or 3 * slack * most * len(probs) <= PACKED
    got = (_walked if packed else _picked)(cells, by, probs, level)
    out = []
    for name, p in probs:
        spot, lo, hi = _spot(p, level), F.col(f"lo_{name}"), F.col(f"hi_{name}")
        missed = (F.col("total") > 0) & (lo.isNull() | hi.isNull())
        error = F.raise_error(F.lit("a quantile lies outside its fence")).cast("double")
        out.append(F.when(missed, error).otherwise(lo + (spot - F.floor(spot)) * (hi - lo)).alias(name))
    return got.select(*by, *out)


#: Cells of a group that are walked in one row.
PACKED = 100_000


def _walked(cells: DataFrame, by: list[str], probs: list[tuple[str, float]], level) -> DataFrame:
    """As ``_picked``, for groups of few cells: one row per group holds them in order and is walked once."""
    rows = cells.groupBy(*by).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("at", "gap", "c"))).alias("cells")
    )
    ranks = {}
    for name, p in probs:
        low = F.floor(_spot(p, level)) + 1
        ranks[f"lo_{name}"], ranks[f"hi_{name}"] = low, F.least(low + 1, F.col("total"))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("upto"), *[none.alias(n) for n in ranks])

    def step(s: Column, x: Column) -> Column:
        upto = s["upto"] + x["c"]
        hit = {n: (r > s["upto"]) & (r <= upto) & (x["gap"] == 0) for n, r in ranks.items()}
        return F.struct(upto.alias("upto"), *[F.when(hit[n], x["at"]).otherwise(s[n]).alias(n) for n in ranks])

    walked = rows.select(*by, "total", F.aggregate("cells", start, step).alias("w"))
    return walked.select(*by, "total", *[F.col(f"w.{n}").alias(n) for n in ranks])


def _spot(p: float, level) -> Column:
    exact = F.lit(float(p)) if level is None else level(p, F.col("total").cast("double"))
    return (F.col("total") - 1) * exact


def _picked(cells: DataFrame, by: list[str], probs: list[tuple[str, float]], level) -> DataFrame:
    """(by, total, lo_, hi_ per probability): the values at the ranks around each quantile, null where a gap holds them."""
    placed = running_totals(cells, [F.col("at"), F.col("gap")], {"last": F.col("c")}, by=by)
    sums = placed.groupBy(*by).agg(F.max("last").alias("total"))
    placed = placed.join(sums, by) if by else placed.withColumn("total", sums.select("total").scalar())

    def at_rank(rank: Column) -> Column:
        hit = (rank > F.col("last") - F.col("c")) & (rank <= F.col("last"))
        return F.max(F.when(hit & (F.col("gap") == 0), F.col("at")))

    picks = []
    for name, p in probs:
        low = F.floor(_spot(p, level)) + 1
        picks += [at_rank(low).alias(f"lo_{name}"), at_rank(F.least(low + 1, F.col("total"))).alias(f"hi_{name}")]
    return placed.groupBy(*by).agg(F.max("total").alias("total"), *picks)


def quantile_row(df: DataFrame, value: Column, probabilities: dict[str, float]) -> Column:
    """Exact quantiles of a whole column as one struct value, usable on any frame."""
    row = exact_quantiles(df, value, probabilities)
    return row.agg(F.struct(*[F.max(n).alias(n) for n in probabilities]).alias("row")).scalar()


def global_quantiles(df: DataFrame, value: Column, probabilities: dict[str, float]) -> dict[str, Column]:
    """Exact quantiles of a whole column, usable as columns on any frame."""
    row = quantile_row(df, value, probabilities)
    return {n: row.getField(n) for n in probabilities}


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics back to rows.

    No hint: adaptive execution broadcasts ``stats`` only when its measured size is small, and otherwise splits
    the partitions of a hot key.
    """
    return df.join(stats, list(keys), how)


def top_rows(df: DataFrame, order_by: Sequence[Column], n: int) -> DataFrame:
    """First n rows by a total order, with their 1-based position (the window sees n rows)."""
    best = df.orderBy(*order_by).limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order_by)))
