"""Product hierarchy: national, warehouse, warehouse/category/subcategory, SKU.

Totals use one grouping-sets aggregation. Least-squares reconciliation uses nested group sums instead of a matrix:
for nested levels the inverse of S'S peels off one level at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecasting.evaluation import mape
from shelfcast.operators.scale import attach
from shelfcast.session import pin

LEVELS = ("national", "warehouse", "category", "sku")
PATH = ("warehouse", "category", "subcategory")


def category_id() -> Column:
    return F.concat_ws("/", *PATH)


def nodes(static: DataFrame) -> DataFrame:
    """Edge table (level, node_id, unique_id): every series under each of its four nodes."""
    ids = [F.lit("Total"), F.col("warehouse"), category_id(), F.col("unique_id")]
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), i.alias("node_id")) for level, i in zip(LEVELS, ids, strict=True)])
    return static.select("unique_id", F.explode(pairs).alias("p")).select("p.level", "p.node_id", "unique_id")


def roll_up(rows: DataFrame, value: str = "y") -> DataFrame:
    """Sum a bottom-level value to all levels: (level, unique_id, ds, value)."""
    keyed = rows.withColumn("node", category_id())
    cube = keyed.groupingSets(
        [[F.col("ds")], [F.col("ds"), F.col("warehouse")], [F.col("ds"), F.col("warehouse"), F.col("node")],
         [F.col("ds"), F.col("warehouse"), F.col("node"), F.col("unique_id")]],
        F.col("ds"), F.col("warehouse"), F.col("node"), F.col("unique_id"),
    ).agg(F.grouping_id().alias("gid"), F.sum(value).alias(value))
    level = F.when(F.col("gid") == 7, "national").when(F.col("gid") == 3, "warehouse").when(F.col("gid") == 1, "category").otherwise("sku")
    node = F.when(F.col("gid") == 7, F.lit("Total")).when(F.col("gid") == 3, F.col("warehouse")).when(
        F.col("gid") == 1, F.col("node")
    ).otherwise(F.col("unique_id"))
    return cube.select(level.alias("level"), node.alias("unique_id"), "ds", value)


def aggregate_levels(demand: DataFrame, static: DataFrame) -> DataFrame:
    return roll_up(attach(demand, static, ["unique_id"]))


def bottom_up(forecasts: DataFrame, static: DataFrame) -> DataFrame:
    """Bottom forecasts summed up; a series without a forecast counts as zero. ``forecasts`` may hold all levels."""
    base = static.join(forecasts.select("unique_id", "ds", "y_hat"), "unique_id")
    return roll_up(base, "y_hat").withColumn("y_hat_reconciled", F.greatest(F.lit(0.0), F.col("y_hat"))).drop("y_hat")


def least_squares(forecasts: DataFrame, static: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Reconcile forecasts of all levels by (weighted) least squares, then clip at zero.

    ``forecasts`` is (level, unique_id, ds, y_hat); a missing node counts as zero. ``weights`` is
    (level, unique_id, variance) for the weighted form. Each level costs one aggregation and one join back. The forecasts are
    stored first, since every level reads them.
    """
    forecasts = pin(forecasts.select("level", "unique_id", "ds", "y_hat"), "base-forecasts")

    def level(name: str, key: str) -> DataFrame:
        rows = forecasts.where(F.col("level") == name)
        if weights is not None:
            w = weights.where(F.col("level") == name).select("unique_id", F.greatest(F.col("variance"), F.lit(1e-9)).alias("w"))
            rows = rows.join(w, "unique_id", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
        else:
            rows = rows.withColumn("w", F.lit(1.0))
        return rows.select(F.col("unique_id").alias(key), "ds", (F.col("y_hat") / F.col("w")).alias(f"g_{name}"), (1 / F.col("w")).alias(f"c_{name}"))

    days = forecasts.select("ds").distinct()
    spans = days.agg(F.array_sort(F.collect_set("ds"))).scalar()  # the forecast days, bounded by the horizon
    grid = static.withColumn("node", category_id()).withColumn("root", F.lit("Total")).select("*", F.explode(spans).alias("ds"))
    keys = {"sku": "unique_id", "category": "node", "warehouse": "warehouse", "national": "root"}
    work = grid
    for name, key in keys.items():
        work = attach(work, level(name, key), [key, "ds"])
    filled = [F.coalesce(F.col(f"g_{name}"), F.lit(0.0)) for name in keys]
    own = F.coalesce(1 / F.col("c_sku"), F.lit(1.0))
    work = work.withColumn("a", own).withColumn("b", own * (filled[0] + filled[1] + filled[2] + filled[3]))
    for name in ("category", "warehouse", "national"):
        key = keys[name]
        sums = work.groupBy(key, "ds").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
        c = F.coalesce(F.col(f"c_{name}"), F.lit(1.0))
        share = F.col("a") * c / (1 + c * F.col("sa"))
        work = attach(work, sums, [key, "ds"]).withColumn("b2", F.col("b") - share * F.col("sb")).withColumn(
            "a2", F.col("a") - share * F.col("sa")
        ).drop("a", "b", "sa", "sb").withColumnsRenamed({"a2": "a", "b2": "b"})
    rolled = roll_up(work.select("unique_id", *PATH, "ds", F.col("b").alias("y_hat")), "y_hat")
    return rolled.withColumn("y_hat_reconciled", F.greatest(F.lit(0.0), F.col("y_hat"))).drop("y_hat")


def reconcile(forecasts: DataFrame, static: DataFrame, method: str = "mint_ols", weights: DataFrame | None = None) -> DataFrame:
    """bottom_up, mint_ols or mint_wls; any other name acts as mint_ols."""
    if method == "bottom_up":
        return bottom_up(forecasts.where(F.col("level") == "sku"), static)
    return least_squares(forecasts, static, weights if method == "mint_wls" else None)


def compare_methods(actual: DataFrame, first: DataFrame, second: DataFrame, target: float = 8.0) -> DataFrame:
    """Error of two reconciled sets on the same actuals and the gain of the second."""
    keys = ["unique_id", "ds"]

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.col("y_hat_reconciled").alias(name))

    joined = actual.join(named(first, "one").join(named(second, "two"), keys, "full"), keys)
    one = joined.agg(
        mape(F.col("y"), F.col("one")).alias("mape_bottom_up"), mape(F.col("y"), F.col("two")).alias("mape_least_squares")
    )
    gain = F.when(F.col("mape_bottom_up") > 0, (F.col("mape_bottom_up") - F.col("mape_least_squares")) / F.col("mape_bottom_up") * 100).otherwise(0.0)
    return one.withColumn("improvement_pct", gain).withColumn("target_met", F.col("improvement_pct") >= target)


def coherence(rolled: DataFrame, value: str = "y", tolerance: float = 0.01) -> DataFrame:
    """The national value and the sum of the warehouses on every day, and whether they agree."""
    per_day = rolled.groupBy("ds").agg(
        F.sum(F.when(F.col("level") == "national", F.col(value))).alias("national"),
        F.sum(F.when(F.col("level") == "warehouse", F.col(value))).alias("warehouses"),
    )
    return per_day.withColumn("coherent", F.abs(F.col("national") - F.col("warehouses")) <= tolerance)


def incoherent_days(rolled: DataFrame, value: str = "y", tolerance: float = 0.01) -> DataFrame:
    """Days on which the national value differs from the sum of its warehouses."""
    return coherence(rolled, value, tolerance).where(~F.col("coherent"))
