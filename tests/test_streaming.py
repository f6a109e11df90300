"""Streaming jobs: restarts neither lose nor repeat rows, and state survives between batches."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from shelfcast.sources.files import write_csv
from shelfcast.streaming import jobs, state


def test_files_are_ingested_once(spark, dirty, tmp_path):
    inbox, table, progress, ckpt = (str(tmp_path / n) for n in ("in", "table", "progress", "ckpt"))
    for n in (1, 2):
        dirty.withColumn("Product_ID", F.concat("Product_ID", F.lit(f"-{n}"))).coalesce(1).write.mode("append").option("header", True).csv(inbox)
        for _ in range(2):  # the second run finds nothing new
            jobs.ingest_files(jobs.feed_stream(spark, inbox), table, progress, ckpt).awaitTermination()
        stored = spark.read.parquet(table)
        assert stored.count() == 5 * n == stored.select("Product_ID").distinct().count()
    assert spark.read.parquet(progress).where("status = 'completed'").count() == 2


def test_streak_state_survives_restart(spark, tmp_path):
    source, ckpt, out = (str(tmp_path / n) for n in ("src", "ckpt", "out"))
    schema = "model string, ds timestamp, mape double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        for part in (range(0, 4), range(4, 8)):
            rows = [("m", dt.datetime(2024, 1, 1 + i), 25.0) for i in part]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = jobs.breach_streaks(spark.readStream.schema(schema).parquet(source))
            jobs.start(stream, lambda df, epoch: jobs.write_batch(df, epoch, out), ckpt, True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{out}/epoch=*").orderBy("ds").collect()
    assert [r.streak for r in got] == list(range(1, 9)) and [r.action for r in got][-2:] == ["AUTO_RETRAIN"] * 2


def test_feature_store_keeps_newest(spark, tmp_path):
    source, store, ckpt = (str(tmp_path / n) for n in ("src", "store", "ckpt"))
    schema = "unique_id string, ds date, y double"
    for day, y in ((1, 1.0), (3, 3.0), (2, 2.0)):
        spark.createDataFrame([("a", dt.date(2024, 1, day), y)], schema).write.mode("append").parquet(source)
        query = jobs.keep_features(spark.readStream.schema(schema).parquet(source), store, ckpt)
        query.awaitTermination()
    rows = spark.read.parquet(f"{store}/version=2").collect()
    assert len(rows) == 1 and rows[0].y == 3.0


def test_latest_value_with_expiry(spark, tmp_path):
    """State with a time to live keeps the query running, so it is stopped once its result is there."""
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, d), float(d)) for d in (1, 5, 3)], "unique_id string, ds timestamp, y double")
    source, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    df.coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        stream = jobs.latest_values(spark.readStream.schema(df.schema).parquet(source), ttl_ms=3_600_000)
        query = jobs.start(stream, lambda batch, epoch: jobs.write_batch(batch, epoch, out), ckpt, False, "update")
        for _ in range(120):
            if (tmp_path / "out" / "epoch=0" / "_SUCCESS").exists():
                break
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r.y for r in spark.read.schema(df.schema).parquet(f"{out}/epoch=0").collect()] == [5.0]


def test_drift_rate_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 5), "ks", h % 2 == 0) for h in range(6)]
    source = str(tmp_path / "v")
    spark.createDataFrame(rows, "ts timestamp, drift_type string, is_drifted boolean").coalesce(1).write.parquet(source)
    stream = jobs.drift_rate(spark.readStream.schema("ts timestamp, drift_type string, is_drifted boolean").parquet(source))
    jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r.slot.hour: r.found for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0}


def test_csv_writer(spark, dirty, tmp_path):
    write_csv(dirty, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns[0] == "Product_ID"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, tmp_path, parts, schema, build, mode="append"):
    """Each part arrives as its own batch; all output rows in order of the batch."""
    source, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.start(build(spark.readStream.schema(schema).parquet(source)), lambda df, epoch: jobs.write_batch(df, epoch, out), ckpt, True, mode).awaitTermination()
    return spark.read.parquet(out).orderBy("epoch").collect()


def replay(requests, limit, seconds):
    """Sequential limiter: only accepted requests of the last span count."""
    kept, out = {}, {}
    for user, ts, name in sorted(requests, key=lambda r: (r[1], r[2])):
        mine = [t for t in kept.get(user, []) if t > ts - dt.timedelta(seconds=seconds)]
        out[user, name] = len(mine) < limit
        kept[user] = mine + [ts] * (len(mine) < limit)
    return out


def test_request_limit_equals_a_replay_with_late_and_tied_requests(rocks, tmp_path):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1, 10)
    requests = [(f"u{i % 3}", start + dt.timedelta(seconds=rng.choice([rng.randrange(600), 30, 60])), f"e{i:03d}") for i in range(240)]
    order = sorted(requests, key=lambda r: r[1].timestamp() + rng.uniform(0, 200))
    parts = [order[:90], order[90:170], order[170:], [("end", start + dt.timedelta(hours=5), "x")]]
    got = batches(rocks, tmp_path, parts, "user_id string, ts timestamp, event_id string", lambda s: state.request_decisions(s, 4, 60, "10 minutes"))
    assert {(r.user_id, r.event_id): r.accepted for r in got} == replay(requests, 4, 60) and len(got) == 240


def test_spikes_judge_late_signals_by_their_own_days(rocks, tmp_path):
    day = dt.datetime(2024, 3, 1, 12)
    calm = [(f"a{i}", "p", "pos", day + dt.timedelta(days=i), 10.0 + i % 2) for i in range(20)]
    later = [(f"b{i}", "p", "pos", day + dt.timedelta(days=40 + i), 1000.0 + 10 * (i % 2)) for i in range(14)]
    late = [("late", "p", "pos", day + dt.timedelta(days=15, hours=1), 30.0), ("fine", "p", "pos", day + dt.timedelta(days=50, hours=1), 1005.0)]
    schema = "event_id string, product_id string, source string, ts timestamp, signal_value double"
    got = batches(rocks, tmp_path, [calm, later, late], schema, lambda s: state.spikes(s, sigma=2.5))
    assert [r.event_id for r in got] == ["late"]
    values = [10.0 + i % 2 for i in range(2, 16)] + [30.0]
    mean = sum(values) / len(values)
    sd = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
    assert got[0].sigma == pytest.approx((30 - mean) / sd)


def test_streaks_of_shuffled_days_equal_ordered_days(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(m, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), rng.choice([10.0, 25.0, 30.0])) for m in ("a", "b") for i in range(60)]
    mixed = rng.sample(rows, len(rows))
    got = batches(rocks, tmp_path, [mixed[:50], mixed[50:90], mixed[90:]], "model string, ds timestamp, mape double", state.ordered_streaks, "update")
    newest = {(r.model, r.ds): (r.streak, r.action) for r in got}
    for m in ("a", "b"):
        n = 0
        for _, day, value in sorted(r for r in rows if r[0] == m):
            n = n + 1 if value > 20 else 0
            assert newest[m, day] == (n, "AUTO_RETRAIN" if n >= 7 else "MONITOR")
    assert len(newest) == 120


def test_old_days_are_closed(rocks, tmp_path):
    days = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 30.0) for i in range(30)]
    got = batches(rocks, tmp_path, [days[:20], days[20:]], "model string, ds timestamp, mape double", lambda s: state.ordered_streaks(s, keep=5), "update")
    assert sorted((r.ds, r.streak) for r in got) == [(d[1], i + 1) for i, d in enumerate(days)]


def test_lookup_reads_the_state(rocks, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d), float(d)) for d in (1, 5, 3)] + [("b", dt.datetime(2024, 1, 2), 7.0)]
    batches(rocks, tmp_path, [rows[:2], rows[2:]], "unique_id string, ds timestamp, y double", jobs.latest_values, "update")
    found = {r.unique_id: (r.ds.day, r.y) for r in state.lookup(rocks, str(tmp_path / "ckpt")).collect()}
    assert found == {"a": (5, 5.0), "b": (2, 7.0)}
    assert [r.unique_id for r in state.lookup(rocks, str(tmp_path / "ckpt"), ["b"]).collect()] == ["b"]


def test_finished_files_go_and_old_ones_are_swept(spark, dirty, tmp_path):
    inbox, table, progress, ckpt = (str(tmp_path / n) for n in ("in", "table", "progress", "ckpt"))
    for n in range(3):
        dirty.limit(2).coalesce(1).write.mode("append").option("header", True).csv(inbox)
        jobs.ingest_files(jobs.feed_stream(spark, inbox, delete=True), table, progress, ckpt).awaitTermination()
    # A finished file is deleted when a later batch begins, so only the newest may still be there.
    for _ in range(50):
        left = list((tmp_path / "in").glob("part-*"))
        if len(left) <= 1:
            break
        time.sleep(0.2)
    assert len(left) <= 1 and spark.read.parquet(table).count() == 6
    folder = tmp_path / "staged"
    folder.mkdir()
    for name in ("old.csv", "young.csv", "_hidden"):
        (folder / name).write_text("x")
    now = time.time()
    os.utime(folder / "old.csv", (now - 1000, now - 1000))
    os.utime(folder / "_hidden", (now - 1000, now - 1000))
    gone = jobs.sweep(spark, str(folder), 600)
    assert [g.rsplit("/", 1)[1] for g in gone] == ["old.csv"] and sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == ["_hidden", "young.csv"]
    assert jobs.sweep(spark, str(tmp_path / "none"), 1) == []


def test_listener_appends_a_row_per_batch(spark, dirty, tmp_path):
    inbox, rows = str(tmp_path / "in"), str(tmp_path / "rows")
    dirty.repartition(3).write.option("header", True).csv(inbox)
    listener = jobs.ProgressRows(spark, rows)
    spark.streams.addListener(listener)
    try:
        stream = jobs.feed_stream(spark, inbox, max_files=1)
        jobs.ingest_files(stream, str(tmp_path / "table"), str(tmp_path / "progress"), str(tmp_path / "ckpt")).awaitTermination()
        for _ in range(100):
            if os.path.isdir(rows) and spark.read.parquet(rows).where("rows > 0").count() == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.parquet(rows).where("rows > 0").collect()
    assert len(got) == 3 == len({r["batch"] for r in got}) and all(r["duration_ms"] > 0 for r in got)
