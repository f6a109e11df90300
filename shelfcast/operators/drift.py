"""Data, prediction and concept drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast import constants as K
from shelfcast.functions.numeric import equal_width_bin
from shelfcast.functions.tails import as_udf, kolmogorov_p
from shelfcast.operators.scale import quantile_row, running_totals, scalars

SMOOTH = 1e-6


def tagged(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value, is_ref) rows of both samples, nulls left out."""
    def long(df: DataFrame, is_ref: int) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        return wide.unpivot([], list(columns), "metric", "value").where("value is not null").withColumn("is_ref", F.lit(is_ref))

    return long(reference, 1).unionByName(long(current, 0))


def ks_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str], minimum: int = 10) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column, for samples of at least ``minimum`` values.

    Both samples collapse to counts per distinct value before anything is ordered.
    """
    cells = tagged(reference, current, columns).groupBy("metric", "value").agg(
        F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("c")
    )
    upto = running_totals(cells, [F.col("value")], {"cr": F.col("r"), "cc": F.col("c")}, by=["metric"])
    sizes = cells.groupBy("metric").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    gap = F.abs(F.col("cr") / F.col("n_ref") - F.col("cc") / F.col("n_cur"))
    return upto.join(sizes.where((F.col("n_ref") >= minimum) & (F.col("n_cur") >= minimum)), "metric").groupBy("metric").agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(gap).alias("statistic")
    )


def data_drift(statistics: DataFrame, threshold: float = K.KS_P_THRESHOLD) -> DataFrame:
    """Asymptotic p value and verdict per column."""
    p = as_udf(kolmogorov_p)(F.col("statistic"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return statistics.withColumn("p_value", p).select(
        F.lit("data_drift").alias("drift_type"), "metric", "statistic", F.lit(threshold).alias("threshold"), "p_value",
        (F.col("p_value") < threshold).alias("is_drifted"),
    )


def _index(binned: DataFrame, bins: int, ref_share: Column, cur_share: Column) -> DataFrame:
    """Stability index over all bins, empty ones included. ``binned`` has one row per non-empty bin."""
    every = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(binned, "bin", "left").fillna(0, ["r", "c"])
    whole = Window.partitionBy()  # a dozen bins
    table = filled.withColumn("nr", F.sum("r").over(whole)).withColumn("nc", F.sum("c").over(whole))
    table = table.withColumn("p", ref_share).withColumn("q", cur_share)
    return table.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def _both(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    return tagged(reference, current, [value]).drop("metric")


def psi_equal_width(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Stability index over equal bins of the reference range; values outside drop out; constant reference gives 0."""
    rows = _both(reference, current, value)
    ref = F.when(F.col("is_ref") == 1, F.col("value"))
    ends = scalars(rows, lo=F.min(ref), hi=F.max(ref), n_cur=F.sum(1 - F.col("is_ref")))
    binned = rows.select("is_ref", equal_width_bin(F.col("value"), ends["lo"], ends["hi"], bins).alias("bin")).where(
        "bin is not null"
    ).groupBy("bin").agg(F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("c"))
    p = (F.col("r") + SMOOTH) / (F.col("nr") + bins * SMOOTH)
    q = (F.col("c") + SMOOTH) / (F.col("nc") + bins * SMOOTH)
    usable = (ends["hi"] > ends["lo"]) & (ends["n_cur"] > 0)
    return _index(binned, bins, p, q).select(F.when(F.coalesce(usable, F.lit(False)), F.col("psi")).otherwise(0.0).alias("psi"))


def psi_deciles(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Stability index over quantile bins of the reference, open at both ends."""
    rows = _both(reference, current, value)
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = quantile_row(rows.where("is_ref = 1"), F.col("value"), names)
    place = sum((F.when(F.col("value") >= F.col(f"edges.{e}"), 1).otherwise(0) for e in names), F.lit(0))
    binned = rows.withColumn("edges", edges).select("is_ref", place.alias("bin")).groupBy("bin").agg(
        F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("c")
    )
    return _index(binned, bins, F.col("r") / F.col("nr") + SMOOTH, F.col("c") / F.col("nc") + SMOOTH)


def prediction_verdict(psi: DataFrame, threshold: float = K.PSI_THRESHOLD) -> DataFrame:
    meaning = F.when(F.col("psi") < K.PSI_THRESHOLD, "no drift").when(F.col("psi") < K.PSI_SEVERE, "moderate").otherwise("significant")
    return psi.select(
        F.lit("prediction_drift").alias("drift_type"), F.col("psi").alias("statistic"), F.lit(threshold).alias("threshold"),
        (F.col("psi") > threshold).alias("is_drifted"), meaning.alias("interpretation"),
    )


def concept_drift(daily: DataFrame, by: Sequence[str] = ("model",), days: int = K.RETRAIN_DAYS, limit: float = K.MAPE_ALERT_PCT) -> DataFrame:
    """Retrain when the last ``days`` errors of a model are all above the limit. ``daily`` is (by, ds, mape)."""
    order = Window.partitionBy(*by).orderBy(F.col("ds").desc())
    last = daily.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= days)
    row = last.groupBy(*by).agg(
        F.count("mape").alias("days_seen"), F.avg("mape").alias("statistic"), F.count(F.when(F.col("mape") > limit, 1)).alias("days_above")
    )
    full = F.col("days_seen") >= days
    hit = full & (F.col("days_above") == F.col("days_seen"))
    return row.select(
        *by, "days_seen", "days_above", F.when(full, F.col("statistic")).otherwise(0.0).alias("statistic"), hit.alias("is_drifted"),
        F.when(~full, "insufficient_history").when(hit, "AUTO_RETRAIN").otherwise("MONITOR").alias("action"),
    )


def breach_streaks(daily: DataFrame, by: Sequence[str] = ("model",), days: int = K.RETRAIN_DAYS, limit: float = K.MAPE_ALERT_PCT) -> DataFrame:
    """Every day on which the trailing window of errors was above the limit throughout."""
    window = Window.partitionBy(*by).orderBy("ds").rowsBetween(-(days - 1), 0)
    return daily.select(
        *by, "ds", "mape", (F.min("mape").over(window) > limit).alias("above"), (F.count("mape").over(window) >= days).alias("full")
    ).where("above and full").drop("above", "full")


def aligned_error(reference: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Mean relative change of rows matched by key, in percent; a zero reference divides by one."""
    joined = reference.select(key, F.col(value).alias("r")).join(current.select(key, F.col(value).alias("c")), key)
    base = F.when(F.col("r") == 0, 1.0).otherwise(F.col("r"))
    return joined.agg(F.count(F.lit(1)).alias("n"), (F.avg(F.abs((F.col("r") - F.col("c")) / base)) * 100).alias("mape_pct"))


def combined_verdict(reference: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Distance, stability index and aligned error in one row; drift if any of them says so."""
    ks = data_drift(ks_statistics(reference, current, [value])).select(
        F.col("statistic").alias("ks_statistic"), "p_value", F.col("is_drifted").alias("ks_drift"), F.lit(1).alias("one")
    )
    psi = psi_deciles(reference, current, value).select("psi", F.lit(1).alias("one"))
    err = aligned_error(reference, current, key, value).select("mape_pct", F.lit(1).alias("one"))
    row = err.join(psi, "one").join(ks, "one", "left").drop("one")
    verdict = F.coalesce(F.col("ks_drift"), F.lit(False)) | (F.col("psi") > K.PSI_THRESHOLD) | (F.col("mape_pct") > K.MAPE_ALERT_PCT)
    return row.withColumn("drift_detected", verdict)


def retrain_decision(checks: DataFrame) -> DataFrame:
    """Retrain if any check of any kind drifted. ``checks`` needs drift_type and is_drifted."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count(F.when(F.col("is_drifted"), 1)).alias("drifted"),
        F.coalesce(F.bool_or("is_drifted"), F.lit(False)).alias("retrain"),
    )


def monitoring_summary(daily: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Length and newest error of each model's history, next to the thresholds in force."""
    return daily.groupBy(*by).agg(
        F.count("mape").alias("history_length"), F.max_by("mape", "ds").alias("latest_mape"),
        F.lit(K.KS_P_THRESHOLD).alias("ks_threshold"), F.lit(K.PSI_THRESHOLD).alias("psi_threshold"),
        F.lit(K.MAPE_ALERT_PCT).alias("mape_threshold"), F.lit(K.RETRAIN_DAYS).alias("retrain_trigger_days"),
    )
