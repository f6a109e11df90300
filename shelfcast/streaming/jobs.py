"""Continuous jobs on Structured Streaming.

Every sink that writes tables does so per micro-batch into a partition named after the batch, replacing it on a
replay, so a restarted job neither loses nor repeats rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from shelfcast import constants as K
from shelfcast.functions.numeric import hits
from shelfcast.operators.etl import CLEAN_COLUMNS, feed_counters, prepare
from shelfcast.operators.features import upsert_features
from shelfcast.session import file_system
from shelfcast.sources.files import RAW_SCHEMA

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_batch(df: DataFrame, epoch: int, path: str, name: str = "epoch") -> None:
    """Replace this epoch's partition of a Parquet table."""
    df.write.mode("overwrite").parquet(f"{path}/{name}={epoch}")


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---- arriving files --------------------------------------------------------------------------------------------


def feed_stream(spark: SparkSession, folder: str, max_files: int = 100, archive: str | None = None, delete: bool = False) -> DataFrame:
    """Dirty inventory files as they arrive; with ``archive`` a finished file moves there, with ``delete`` it goes."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("header", True).option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    return reader.csv(folder)


def sweep(spark: SparkSession, folder: str, keep_seconds: float, now: float | None = None) -> list[str]:
    """Delete files of a folder that were last changed more than ``keep_seconds`` ago; their paths.

    It catches what a stream's own cleaning leaves: files of failed runs, and those that were staged but never read. Hidden
    files are left alone.
    """
    fs, at = file_system(spark, folder)
    limit, gone = ((time.time() if now is None else now) - keep_seconds) * 1000, []
    for found in fs.listStatus(at) if fs.exists(at) else ():
        path = found.getPath()
        if found.isFile() and not path.getName().startswith((".", "_")) and found.getModificationTime() < limit and fs.delete(path, False):
            gone.append(path.toString())
    return sorted(gone)


class ProgressRows(StreamingQueryListener):
    """Appends one row per batch of every query of the session to a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), p.name, p.batchId, p.timestamp, p.numInputRows, int(p.batchDuration), float(p.processedRowsPerSecond or 0.0))
        kind = "query string, name string, batch long, at string, rows long, duration_ms long, rows_per_second double"
        self.spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest_files(stream: DataFrame, table: str, progress: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Clean every batch of files, store it under its batch id, and append progress rows."""

    def handle(batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count() == 0:
            return
        prepared = prepare(batch).persist()
        try:
            clean = prepared.select(*CLEAN_COLUMNS, F.current_timestamp().alias("ingested_at"))
            write_batch(clean, epoch, table, "batch_id")
            steps = F.array(*[F.struct(F.lit("etl").alias("stage"), F.lit(s).alias("status")) for s in ("running", "completed")])
            rows = feed_counters(prepared).select(F.to_json(F.struct("*")).alias("detail")).select(F.explode(steps).alias("s"), "detail")
            rows = rows.select("s.stage", "s.status", F.when(F.col("s.status") == "completed", F.col("detail")).alias("detail"))
            write_batch(rows.withColumn("at", F.current_timestamp()), epoch, progress, "batch_id")
        finally:
            prepared.unpersist()

    return start(stream, handle, checkpoint, once)


# ---- windowed operations metrics -------------------------------------------------------------------------------


def request_metrics(log: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Requests, errors, error rate and latency quantiles per tumbling window."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"))
        .agg(
            F.count(F.lit(1)).alias("requests"), hits(F.col("status_code") >= 500).alias("errors"),
            F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], 1000).alias("latency"),
            *[hits(F.col("duration_ms") <= e * 1000).alias(f"le_{i}") for i, e in enumerate(K.LATENCY_BUCKETS)],
        )
        .select(
            F.col("window.start").alias("slot"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"),
            F.col("latency")[0].alias("p50"), F.col("latency")[1].alias("p95"), F.col("latency")[2].alias("p99"),
            *[f"le_{i}" for i in range(len(K.LATENCY_BUCKETS))],
        )
    )


def busy_clients(log: DataFrame, limit: int = K.RATE_LIMIT_PER_MINUTE, seconds: int = 60, slide: int = 10, late: str = "10 minutes") -> DataFrame:
    """Clients with more than ``limit`` requests in a sliding window."""
    return (
        log.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select("user_id", F.col("window.start").alias("slot"), "requests")
    )


def daily_signals(signals: DataFrame, late: str = "2 days") -> DataFrame:
    """Count and sums of signals per product, source and day."""
    v = F.col("signal_value")
    return (
        signals.withWatermark("ts", late)
        .groupBy("product_id", "source", F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))
        .select("product_id", "source", F.col("window.start").alias("day"), "n", "total", "squares")
    )


def spike_alerts(signals: DataFrame, history: str, alerts: str, checkpoint: str, days: int = 14, sigma: float = K.SPIKE_SIGMA, once: bool = True) -> StreamingQuery:
    """Compare each signal with the last days of its product.

    Only day sums are kept, in one partition per day and batch; a batch reads the partitions of the last ``days`` alone.
    """
    v = F.col("signal_value")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        sums = batch.groupBy("product_id", F.to_date("ts").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares")
        )
        parts = sums.withColumn("epoch", F.lit(epoch)).write.partitionBy("day", "epoch").option("partitionOverwriteMode", "dynamic")
        parts.mode("overwrite").parquet(history)
        seen = sums.agg(F.max("day").alias("day")).first()["day"]
        if seen is None:
            return
        kept = spark.read.schema("product_id string, n long, total double, squares double, day date, epoch long").parquet(history)
        newest = kept.where(F.col("day") >= F.lit(seen)).agg(F.max("day")).first()[0]
        m = kept.where(F.col("day") > F.date_sub(F.lit(newest), days)).groupBy("product_id").agg(
            F.sum("n").alias("n"), F.sum("total").alias("s1"), F.sum("squares").alias("s2")
        ).where("n >= 2")
        sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)))
        m = m.select("product_id", (F.col("s1") / F.col("n")).alias("mean"), sd.alias("sd")).where("sd > 0")
        scored = batch.join(m, "product_id").withColumn("sigma", (v - F.col("mean")) / F.col("sd"))
        write_batch(scored.where(F.col("sigma") > sigma).drop("mean", "sd"), epoch, alerts)

    return start(signals, handle, checkpoint, once)


# ---- keyed state -----------------------------------------------------------------------------------------------


class StreakCounter(StatefulProcessor):
    """Counts consecutive error breaches of a model and says when to retrain."""

    def __init__(self, limit: float = K.MAPE_ALERT_PCT, days: int = K.RETRAIN_DAYS):
        self.limit, self.days = limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ds")
        n = self.streak.get()[0] if self.streak.exists() else 0
        counts = []
        for above in frame["mape"] > self.limit:
            n = n + 1 if above else 0
            counts.append(n)
        self.streak.update((n,))
        yield pd.DataFrame({
            "model": key[0], "ds": frame["ds"].to_numpy(), "streak": counts,
            "action": ["AUTO_RETRAIN" if c >= self.days else "MONITOR" for c in counts],
        })

    def close(self) -> None:
        pass


def breach_streaks(daily: DataFrame) -> DataFrame:
    """(model, ds, streak, action) for a stream of daily errors (model, ds, mape)."""
    return daily.groupBy("model").transformWithStateInPandas(
        StreakCounter(), "model string, ds timestamp, streak long, action string", "Append", "None"
    )


class LatestValue(StatefulProcessor):
    """Newest feature row per series; state older than its time to live is dropped by the store."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("ds", T.TimestampType()), T.StructField("y", T.DoubleType())])
        self.latest = handle.getValueState("latest", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("latest", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            top = pdf.loc[pdf["ds"].idxmax()]
            if best is None or top["ds"] > best[0]:
                best = (top["ds"], float(top["y"]))
        if self.latest.exists():
            ds, y = self.latest.get()
            if pd.Timestamp(ds) >= pd.Timestamp(best[0]):
                best = (pd.Timestamp(ds), y)
        self.latest.update((pd.Timestamp(best[0]).to_pydatetime(), best[1]))
        yield pd.DataFrame({"unique_id": [key[0]], "ds": [best[0]], "y": [best[1]]})

    def close(self) -> None:
        pass


def latest_values(demand: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Newest value per series as a stream of updates."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return demand.groupBy("unique_id").transformWithStateInPandas(LatestValue(ttl_ms), "unique_id string, ds timestamp, y double", "Update", mode)


def keep_features(features: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold each batch of feature rows into a table of the newest row per series.

    Versions are numbered by epoch and only the one before is read, so a replay builds the same version again.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0:
            merged = upsert_features(batch.limit(0), batch)
        else:
            merged = upsert_features(spark.read.schema(batch.schema).parquet(f"{store}/version={epoch - 1}"), batch)
        write_batch(merged.select(*batch.columns), epoch, store, "version")

    return start(features, handle, checkpoint, once)


def drift_rate(verdicts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drift findings per hour and kind."""
    return verdicts.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "drift_type").agg(
        hits(F.col("is_drifted")).alias("found")
    ).select(F.col("window.start").alias("slot"), "drift_type", "found")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is available now into Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True
    ).start()


def event_time(col: str) -> Column:
    """Watermarks need a timestamp with time zone."""
    return F.col(col).cast("timestamp")
