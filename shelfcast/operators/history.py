"""Run history, audit log and operational analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.constants import STAGES
from shelfcast.functions.numeric import hits
from shelfcast.operators.scale import exact_quantiles


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "batch_id").limit(n)


def run_status(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with its finished stages and progress. A run has at most one result per stage."""
    done = results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("position", "analysis_type"))), lambda x: x.analysis_type).alias("completed_stages")
    )
    joined = runs.join(done, "batch_id", "left")
    return joined.select(
        *runs.columns,
        F.coalesce("completed_stages", F.array().cast("array<string>")).alias("completed_stages"),
        F.floor(F.coalesce("n", F.lit(0)) * 100 / len(STAGES)).cast("int").alias("progress_pct"),
    )


def stage_progress(stage: Column, status: Column) -> Column:
    """Percent of a run when a stage starts, ends or fails."""
    number = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return (
        F.when(status == "completed", F.floor(number * 100 / len(STAGES)))
        .when(status == "running", F.floor((number - 1) * 100 / len(STAGES)))
        .otherwise(0)
        .cast("int")
    )


def analysis_of(results: DataFrame, kind: str) -> DataFrame:
    if kind not in STAGES:
        raise ValueError(f"analysis type must be one of {list(STAGES)}")
    return results.where(F.col("analysis_type") == kind)


def run_detail(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with its analyses nested."""
    nested = results.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "analysis_type", "result_json"))).alias("analyses")
    )
    return runs.join(nested, "batch_id", "left")


def latest_kpis(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The statistics result of the run that completed last."""
    last = runs.where("status = 'completed'").agg(F.max_by(F.struct("batch_id", "completed_at"), F.struct("completed_at", "batch_id")).alias("r"))
    return last.select("r.*").join(analysis_of(results, "stats"), "batch_id").select("batch_id", "completed_at", "result_json")


def kpi_history(runs: DataFrame, results: DataFrame, limit: int = 20) -> DataFrame:
    """Statistics results of the newest ``limit`` completed runs, with the KPI values parsed; at most 100 can be asked for."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    n = limit
    joined = runs.where("status = 'completed'").join(analysis_of(results, "stats"), "batch_id")
    newest = joined.orderBy(F.col("completed_at").desc(), "batch_id").limit(n)
    kpi = F.from_json("result_json", "units long, value string")
    return newest.select("batch_id", "completed_at", kpi.alias("k")).select(
        "batch_id", "completed_at", F.col("k.units").alias("units"), F.col("k.value").cast("double").alias("value")
    )


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order; at most 10 000 rows can be asked for."""
    if offset < 0 or not 0 <= limit <= 10_000:
        raise ValueError("offset must not be negative and limit must be 0 to 10 000")
    return df.orderBy(*order).offset(offset).limit(limit)


def audit_query(
    log: DataFrame, user_id: str | None = None, action: str | None = None, resource_prefix: str | None = None,
    min_status: int | None = None, max_status: int | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Newest matching audit events first."""
    out = log
    if user_id:
        out = out.where(F.col("user_id") == user_id)
    if action:
        out = out.where(F.col("action") == action)
    if resource_prefix:
        out = out.where(F.col("resource").startswith(resource_prefix))
    if min_status is not None:
        out = out.where(F.col("status_code") >= min_status)
    if max_status is not None:
        out = out.where(F.col("status_code") <= max_status)
    return out.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(offset).limit(limit)


def audit_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("user_id").alias("unique_users"),
        hits(F.col("status_code") >= 400).alias("error_count"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"),
    )


def window_health(log: DataFrame, minutes: int = 5) -> DataFrame:
    """Requests, server errors and latency quantiles per tumbling window."""
    slot = F.window("ts", f"{minutes} minutes").getField("start")
    timed = log.withColumn("slot", slot)
    counts = timed.groupBy("slot").agg(F.count(F.lit(1)).alias("requests"), hits(F.col("status_code") >= 500).alias("errors"))
    latency = exact_quantiles(timed, F.col("duration_ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=["slot"])
    return counts.join(latency, "slot").withColumn("error_rate", F.col("errors") / F.col("requests"))


def service_levels(log: DataFrame, minutes: int = 5) -> DataFrame:
    """Objectives: availability, share of windows within the latency limits and the error budget used."""
    w = window_health(log, minutes)
    row = w.agg(
        ((1 - F.sum("errors") / F.sum("requests")) * 100).alias("availability"),
        (F.avg(F.when(F.col("p95") < 500, 1.0).otherwise(0.0)) * 100).alias("p95_windows"),
        (F.avg(F.when(F.col("p99") < 2000, 1.0).otherwise(0.0)) * 100).alias("p99_windows"),
        F.sum("errors").alias("errors"), F.sum("requests").alias("requests"),
    )
    allowed = F.col("requests") * 0.001
    goals = F.array(
        F.struct(F.lit("api-availability").alias("objective"), F.col("availability").alias("value"), F.lit(99.9).alias("target"), (F.col("availability") >= 99.9).alias("met")),
        F.struct(F.lit("api-latency-p95").alias("objective"), F.col("p95_windows").alias("value"), F.lit(99.0).alias("target"), (F.col("p95_windows") >= 99.0).alias("met")),
        F.struct(F.lit("api-latency-p99").alias("objective"), F.col("p99_windows").alias("value"), F.lit(99.0).alias("target"), (F.col("p99_windows") >= 99.0).alias("met")),
        F.struct(F.lit("error-budget").alias("objective"), (F.col("errors") / allowed * 100).alias("value"), F.lit(100.0).alias("target"), (F.col("errors") <= allowed).alias("met")),
    )
    return row.select(F.explode(goals).alias("g")).select("g.*")


def forecast_objective(per_product: DataFrame, limit: float = 15.0, target: float = 95.0) -> DataFrame:
    """Share of products whose error is under the limit. ``per_product`` is (unique_id, mape)."""
    share = F.avg(F.when(F.col("mape") < limit, 1.0).otherwise(0.0)) * 100
    return per_product.agg(F.count(F.lit(1)).alias("products"), share.alias("value")).withColumn("met", F.col("value") >= target)


def pipeline_objective(runs: DataFrame, target: float = 95.0) -> DataFrame:
    """Success share of finished runs."""
    done = runs.where("status in ('completed', 'failed')")
    return done.agg(F.count(F.lit(1)).alias("runs"), (F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)) * 100).alias("value")).withColumn(
        "met", F.col("value") >= target
    )


def freshness(log: DataFrame, action: Column, hours: int = 6) -> DataFrame:
    """Longest time between two checks, and whether every gap stayed within the limit.

    Gaps are taken between hourly slots first, so the ordered window holds hours, not events.
    """
    slots = log.where(action).groupBy(F.date_trunc("hour", "ts").alias("slot")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    gap = F.unix_micros("a") - F.lag(F.unix_micros("b")).over(Window.orderBy("slot"))
    row = slots.select((gap / 3.6e9).alias("hours")).agg(F.max("hours").alias("longest_gap_hours"))
    return row.withColumn("met", F.col("longest_gap_hours") <= hours)


def alerts(health: DataFrame) -> DataFrame:
    """Alert rules over window health: error rate above 5 % and P95 above half a second."""
    rules = F.array(
        F.when(F.col("error_rate") > 0.05, F.struct(F.lit("HighErrorRate").alias("alert"), F.lit("warning").alias("severity"), F.col("error_rate").alias("value"))),
        F.when(F.col("p95") > 500, F.struct(F.lit("HighLatency").alias("alert"), F.lit("warning").alias("severity"), (F.col("p95") / 1000).alias("value"))),
    )
    return health.select("slot", F.explode(F.array_compact(rules)).alias("a")).select("slot", "a.*")


def rate_limit_breaches(log: DataFrame, limit: int = 30, seconds: int = 60, slide: int = 10) -> DataFrame:
    """Sliding windows in which one client made more than ``limit`` requests."""
    return log.groupBy("user_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds").getField("start").alias("slot")).agg(
        F.count(F.lit(1)).alias("requests")
    ).where(F.col("requests") > limit)


def latency_histogram(log: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Cumulative request counts per latency bucket, as a histogram exporter reports them."""
    seconds = F.col("duration_ms") / 1000
    cells = [F.struct(F.lit(float(e)).alias("le"), hits(seconds <= e).alias("requests")) for e in edges]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.count(F.lit(1)).alias("requests")))
    return log.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
