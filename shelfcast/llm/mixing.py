"""Mixing sources to target weights by systematic sampling, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.common import boxed, text_of, word_count
from shelfcast.operators.scale import running_totals


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Target words of every source: (source, source_size, target).

    ``sizes`` has one row per (source, source_size). Sources in code point order, null last, take ``weights`` in turn.
    They share ``share`` times all words by weight, but none gets more than ``limit`` times its own; what is cut off is
    shared again by weight. Sorted by limit per weight, the sources at their limit are exactly a leading run, so the
    sharing needs no iteration. The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    everything = Window.partitionBy()
    tight = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    rest = (
        sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(limit))).alias("most"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("w_left"))
        .withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("before", "level"))).over(everything).getField("level")
    return rest.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One random number in [0, 1) per source, a multiple of 2**-20 so that sums with row counts stay exact."""
    named = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def mix_plan(docs: DataFrame, size: Column, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 1) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with source, size, source_size, target and ``copies``.

    A row of a source is expected ``target / source_size`` times. Rows of a source are put in order of size, then
    doc_id; the expected copies are summed up along that order, one random offset per source is added, and a row is
    taken once for each whole number that its interval crosses. Rows of nearly equal size stand next to each other, so
    the words taken differ from the target by about the size of the largest row.

    Sums along the order come from ``running_totals``: rows are range-partitioned by (source, size, doc_id), so a source
    with a third of all rows spreads over many tasks. Reruns give the same copies. Null texts have size 0, a null
    source is a source of its own, a source without words has target 0, repeated rows count one by one (which of two
    equal rows gets the extra copy is the same as either), an empty table gives an empty result.
    """
    work = boxed(docs, F.col("source"), F.col("doc_id"), size.alias("size"))
    ranked = running_totals(work, [F.col("size"), F.col("doc_id")], {"rank": F.lit(1)}, by=["source"])
    totals = work.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, limit).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.floor(F.col("rank") * rate + offset(F.col("source"), seed))
    before = F.floor((F.col("rank") - 1) * rate + offset(F.col("source"), seed))
    copies = F.least(upto - before, F.ceil(rate))
    return ranked.join(targets, ranked["source"].eqNullSafe(targets["__source"])).select(
        "row", "source", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 1) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with their own columns, each as often as the plan takes it."""
    plan = mix_plan(docs, word_count(text_of()), weights, share, limit, seed)
    return plan.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
