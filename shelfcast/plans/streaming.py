"""Registered queries that run a Structured Streaming job over the event log and return what it wrote."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.constants import LATENCY_BUCKETS
from shelfcast.plans import base
from shelfcast.plans.base import BRAND, Query, sql
from shelfcast.plans.planning import LOG, SIGNALS, daily_errors, stamp, stamp_sql
from shelfcast.session import work_folder
from shelfcast.sources import feeds
from shelfcast.streaming import jobs, state

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(work_folder(spark), f"stream-{name}-{uuid.uuid4().hex}")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = feeds.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_files(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a derived table and stream its files."""
    path = scratch(spark, f"{name}-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def streamed_log(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.log_columns(stream_table(spark, folder, "events"))


def streamed_signals(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.signal_columns(stream_table(spark, folder, "events"))


def stream_session(spark: SparkSession, keyed_state: bool = False) -> SparkSession:
    """A session for one stream, so that its settings touch nothing else.

    ``spark.shelfcast.statePartitions`` sets the number of state partitions where it should differ from the shuffles'.
    """
    own = spark.newSession()
    parts = spark.conf.get("spark.shelfcast.statePartitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", parts)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if keyed_state:
        own.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    return own


def drain(spark: SparkSession, stream_of, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Run a windowed job over what is there, and give the newest row of every window, also of those still open."""
    out = scratch(spark, name)
    stream = stream_of(stream_session(spark))
    jobs.start(stream, lambda df, epoch: jobs.write_batch(df, epoch, out), scratch(spark, f"{name}-ckpt"), True, "update").awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "epoch").alias("v"))
    return newest.select(*keys, "v.*")


def keyed(spark: SparkSession, stream_of, name: str, mode: str = "append") -> DataFrame:
    """Drain a keyed-state job; it needs the RocksDB store."""
    stream = stream_of(stream_session(spark, keyed_state=True))
    out, ckpt = scratch(spark, name), scratch(spark, f"{name}-ckpt")
    jobs.start(stream, lambda df, epoch: jobs.write_batch(df, epoch, out), ckpt, True, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/epoch=*")


BUCKETS = ", ".join(f"count(*) FILTER (duration_ms <= {e * 1000}) AS le_{i}" for i, e in enumerate(LATENCY_BUCKETS))


@register("stream_request_metrics", sql(LOG, f""", b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, {BUCKETS} FROM log GROUP BY 1)
SELECT {stamp_sql('slot')}, requests, errors, round(errors / requests, 6) AS error_rate, COLUMNS('le_.*') FROM (SELECT * FROM hw JOIN b USING (slot))"""))
def _(spark, folder):
    out = drain(spark, lambda own: jobs.request_metrics(streamed_log(own, folder)), "metrics", ("slot",))
    return out.select(stamp("slot"), "requests", "errors", F.round("error_rate", 6).alias("error_rate"), *[f"le_{i}" for i in range(len(LATENCY_BUCKETS))])


@register("stream_busy_clients", sql(LOG, """, s AS (SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds((k * 10)::BIGINT) AS slot FROM log, range(6) r(k))
SELECT user_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS requests FROM s GROUP BY user_id, s.slot HAVING count(*) > 1"""))
def _(spark, folder):
    out = drain(spark, lambda own: jobs.busy_clients(streamed_log(own, folder), limit=1), "clients", ("user_id", "slot"))
    return out.select("user_id", stamp("slot"), "requests")


def closed(spark: SparkSession, rows: DataFrame, name: str, end: DataFrame) -> str:
    """A folder with ``rows`` in one file set and, newer, ``end``: rows that only move the watermark beyond all others."""
    path = scratch(spark, name)
    rows.write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    return path


@register("stream_request_decisions", "WITH RECURSIVE " + LOG.strip() + """,
o AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM log),
r AS (SELECT user_id, n, ts, event_id, TRUE AS accepted, [ts] AS times FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.ts, o.event_id, len(k) < 1, CASE WHEN len(k) < 1 THEN list_append(k, o.ts) ELSE k END
  FROM (SELECT o.*, list_filter(r.times, lambda t: t > o.ts - INTERVAL 60 SECOND) AS k FROM o JOIN r ON o.user_id = r.user_id AND o.n = r.n + 1) o)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, accepted FROM r""")
def _(spark, folder):
    log = feeds.request_log(spark, folder).select("user_id", "ts", "event_id")
    end = log.agg(F.max("ts").alias("ts")).select(F.lit("").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("").alias("event_id"))
    path = closed(spark, log, "requests", end)

    def stream(own):
        files = own.readStream.schema(log.schema).option("maxFilesPerTrigger", max(1, len(spark.read.parquet(path).inputFiles()) - 1)).parquet(path)
        return state.request_decisions(files, limit=1)

    out = keyed(spark, stream, "decisions")
    return out.where("user_id <> ''").select("user_id", stamp("ts"), "event_id", "accepted")


@register("stream_daily_signals", sql(SIGNALS, """, e AS (SELECT s.*, e.ts FROM signals s JOIN events e USING (event_id))
SELECT product_id, source, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(signal_value), 2) AS total FROM e
GROUP BY product_id, source, time_bucket(INTERVAL 1 DAY, ts)"""))
def _(spark, folder):
    out = drain(spark, lambda own: jobs.daily_signals(streamed_signals(own, folder)), "signals", ("product_id", "source", "day"))
    return out.select("product_id", "source", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("total", 2).alias("total"))


@register("stream_spike_alerts", sql(SIGNALS, """, e AS (SELECT s.event_id, s.product_id, s.source, s.signal_value, e.ts FROM signals s JOIN events e USING (event_id)),
d AS (SELECT product_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(signal_value) AS s1, sum(signal_value * signal_value) AS s2 FROM e GROUP BY 1, 2),
w AS (SELECT a.product_id, a.day, sum(b.n) AS n, sum(b.s1) AS s1, sum(b.s2) AS s2 FROM d a JOIN d b ON a.product_id = b.product_id AND b.day > a.day - 14 AND b.day <= a.day GROUP BY 1, 2),
m AS (SELECT product_id, day, s1 / n AS m, sqrt(greatest(0, (s2 - s1 * s1 / n) / (n - 1))) AS sd FROM w WHERE n >= 2)
SELECT event_id, e.product_id, source, round((signal_value - m) / sd, 4) AS sigma FROM e JOIN m ON m.product_id = e.product_id AND m.day = CAST(e.ts AS DATE)
WHERE sd > 0 AND (signal_value - m) / sd > 2.5"""))
def _(spark, folder):
    out = keyed(spark, lambda own: state.spikes(streamed_signals(own, folder), keep=100_000), "spikes")
    return out.select("event_id", "product_id", "source", F.round("sigma", 4).alias("sigma"))


@register("stream_breach_streaks", sql(BRAND, """,
f AS (SELECT *, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rm FROM y),
d AS (SELECT unique_id AS model, ds, abs(y - rm) / y * 100 > 20 AS hit FROM f WHERE y > 0 AND rm IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY ds) AS grp FROM d),
s AS (SELECT model, ds, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY model, grp ORDER BY ds)::BIGINT AS streak FROM g)
SELECT model, strftime(ds, '%Y-%m-%d') AS ds, streak, CASE WHEN streak >= 7 THEN 'AUTO_RETRAIN' ELSE 'MONITOR' END AS action FROM s"""))
def _(spark, folder):
    """Days arrive in the order of a hash, in several batches; the newest row of each day holds."""
    daily = daily_errors(spark, folder).withColumn("ds", F.col("ds").cast("timestamp"))
    shuffled = daily.repartition(4, F.xxhash64("model", "ds"))

    def stream(own):
        path = scratch(spark, "daily-in")
        shuffled.write.parquet(path)
        return state.ordered_streaks(own.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(path))

    own = stream_session(spark, keyed_state=True)
    out, changes = scratch(spark, "streaks"), stream(own)
    jobs.start(changes, lambda df, epoch: jobs.write_batch(df, epoch, out), scratch(spark, "streaks-ckpt"), True, "update").awaitTermination()
    rows = spark.read.parquet(out)
    newest = rows.groupBy("model", "ds").agg(F.max_by(F.struct("streak", "action"), "epoch").alias("v"))
    return newest.select("model", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "v.streak", "v.action")


LATEST = sql(BRAND, "SELECT unique_id, strftime(max(ds), '%Y-%m-%d') AS ds, arg_max(y, ds) AS y FROM y GROUP BY 1")


@register("stream_latest_values", LATEST)
def _(spark, folder):
    demand = base.brand_demand(spark, folder).withColumn("ds", F.col("ds").cast("timestamp"))
    out = keyed(spark, lambda own: jobs.latest_values(stream_files(own, demand, "demand")), "latest", "update")
    newest = out.groupBy("unique_id").agg(F.max_by(F.struct("ds", "y"), "ds").alias("v"))
    return newest.select("unique_id", F.date_format("v.ds", "yyyy-MM-dd").alias("ds"), "v.y")


@register("stream_feature_store", LATEST)
def _(spark, folder):
    """The online lookup: newest values come from the stream's state, no table is kept."""
    demand = base.brand_demand(spark, folder).withColumn("ds", F.col("ds").cast("timestamp"))
    own, checkpoint = stream_session(spark, keyed_state=True), scratch(spark, "store-ckpt")
    updates = jobs.latest_values(stream_files(own, demand, "features"))
    jobs.start(updates, lambda df, epoch: df.write.format("noop").mode("overwrite").save(), checkpoint, True, "update").awaitTermination()
    return state.lookup(own, checkpoint).select("unique_id", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "y")


@register("stream_file_ingest")
def _(spark, folder):
    from shelfcast.operators.etl import RAW_COLUMNS
    from shelfcast.sources.files import write_csv

    inbox, table = scratch(spark, "inbox"), scratch(spark, "snapshots")
    write_csv(base.raw(spark, folder).select(*RAW_COLUMNS), inbox)
    jobs.ingest_files(jobs.feed_stream(spark, inbox), table, scratch(spark, "progress"), scratch(spark, "ingest-ckpt")).awaitTermination()
    return spark.read.parquet(table).groupBy("Stock_Status").agg(F.count(F.lit(1)).alias("skus"))


@register("full_batch")
def _(spark, folder):
    from shelfcast.operators.batch import run_batch

    return run_batch(base.raw(spark, folder), "batch_0001", scratch(spark, "batch"), feeds.demand_signals(spark, folder))
