"""Keyed state that decides in event time: request limits, demand spikes, error streaks, newest features."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfcast import constants as K

LONG = T.LongType()


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


# ---- request limit ---------------------------------------------------------------------------------------------


def admit(requests: Iterable[tuple[int, str]], accepted: list[int], limit: int, span_us: int) -> Iterator[tuple[int, str, bool]]:
    """(time, id, accepted) of one client's requests in order. Only accepted requests of the last span count; ``accepted``
    holds their times and is updated in place."""
    for at, name in requests:
        while accepted and accepted[0] <= at - span_us:
            accepted.pop(0)
        fits = len(accepted) < limit
        if fits:
            accepted.append(at)
        yield at, name, fits


class RequestLimit(StatefulProcessor):
    """Requests wait until the watermark has passed them and are then decided in order of time and id.

    State: waiting requests, and the times of the last accepted ones, at most ``limit``. Timers fire at each waiting time.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", fields(at=LONG, event_id=T.StringType()))
        self.accepted = handle.getValueState("accepted", fields(times=T.ArrayType(LONG)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(at, frame["event_id"].tolist(), strict=True)))
            due.update(t // 1000 + 1 for t in at)
        for ms in due:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get())
        ready = sorted((w[0], w[1]) for w in waiting if w[0] < until)
        if not ready:
            return
        left = [(w[0], w[1]) for w in waiting if w[0] >= until]
        self.waiting.put(left) if left else self.waiting.clear()
        accepted = list(self.accepted.get()[0]) if self.accepted.exists() else []
        out = list(admit(ready, accepted, self.limit, self.span))
        self.accepted.update((accepted,))
        yield pd.DataFrame({
            "user_id": key[0], "ts": pd.to_datetime([o[0] for o in out], unit="us"), "event_id": [o[1] for o in out], "accepted": [o[2] for o in out],
        })

    def close(self) -> None:
        pass


def request_decisions(log: DataFrame, limit: int = K.RATE_LIMIT_PER_MINUTE, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, ts, event_id, accepted) for a stream of requests: a rejected request does not count against the next one.

    Requests may arrive out of order by up to ``late``; the result does not depend on the order of arrival.
    """
    rows = log.select("user_id", "ts", "event_id").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(
        RequestLimit(limit, seconds), "user_id string, ts timestamp, event_id string, accepted boolean", "Append", "EventTime"
    )


# ---- spikes ----------------------------------------------------------------------------------------------------


class SpikeJudge(StatefulProcessor):
    """Day sums of a product in map state; a signal is compared with the days up to its own."""

    def __init__(self, days: int, sigma: float, keep: int):
        self.days, self.sigma, self.keep = days, sigma, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.DoubleType()
        self.sums = handle.getMapState("days", fields(day=LONG), fields(n=LONG, total=number, squares=number))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        day = frame["ts"].astype("datetime64[us]").astype("int64") // 86_400_000_000
        for d, part in frame.groupby(day)["signal_value"]:
            at = (int(d),)
            n, total, squares = self.sums.getValue(at) if self.sums.containsKey(at) else (0, 0.0, 0.0)
            self.sums.updateValue(at, (n + len(part), total + float(part.sum()), squares + float((part * part).sum())))
        known = {k[0]: v for k, v in self.sums.iterator()}
        newest = max(known)
        for d in [d for d in known if d <= newest - self.keep]:
            self.sums.removeKey((d,))
        scores = []
        seen: dict[int, tuple[float, float] | None] = {}
        for d, v in zip(day.tolist(), frame["signal_value"].tolist(), strict=True):
            if d not in seen:
                window = [known[x] for x in range(d - self.days + 1, d + 1) if x in known]
                n, s1, s2 = (sum(w[i] for w in window) for i in range(3))
                spread = math.sqrt(max(0.0, (s2 - s1 * s1 / n) / (n - 1))) if n >= 2 else 0.0
                seen[d] = (s1 / n, spread) if spread > 0 else None
            scores.append((v - seen[d][0]) / seen[d][1] if seen[d] else float("nan"))
        out = frame.assign(sigma=scores)
        yield out[out["sigma"] > self.sigma][["event_id", "product_id", "source", "ts", "signal_value", "sigma"]]

    def close(self) -> None:
        pass


def spikes(signals: DataFrame, days: int = 14, sigma: float = K.SPIKE_SIGMA, keep: int = 60) -> DataFrame:
    """Signals that stand out from the ``days`` days of their product up to their own day, as far as these have arrived.

    A product's state is one row for each of its last ``keep`` days; no table is read. A late signal is compared with
    its own days.
    """
    event = signals.schema["event_id"].dataType.simpleString()
    return signals.groupBy("product_id").transformWithStateInPandas(
        SpikeJudge(days, sigma, keep), f"event_id {event}, product_id string, source string, ts timestamp, signal_value double, sigma double", "Append", "None"
    )


# ---- streaks ---------------------------------------------------------------------------------------------------


def streaks(above: list[tuple[int, bool]], before: int = 0) -> list[tuple[int, int]]:
    """(day, days in a row above the limit) in order of day, ``before`` of them earlier."""
    out = []
    for day, hit in above:
        before = before + 1 if hit else 0
        out.append((day, before))
    return out


class OrderedStreaks(StatefulProcessor):
    """Days of a model in order of event time; a late day opens its run again and the changed days are given anew.

    State: the days that may still be changed, and the streak before them.
    """

    def __init__(self, limit: float, days: int, keep: int | None):
        self.limit, self.days, self.keep = limit, days, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("days", fields(days=T.ArrayType(LONG), hits=T.ArrayType(T.BooleanType()), before=LONG))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days, hits, before = self.state.get() if self.state.exists() else ([], [], 0)
        known = dict(zip(days, hits, strict=True))
        was = dict(streaks(sorted(known.items()), before))
        frame = pd.concat(list(rows), ignore_index=True)
        at = frame["ds"].astype("datetime64[us]").astype("int64") // 86_400_000_000
        known.update(zip(at.tolist(), (frame["mape"] > self.limit).tolist(), strict=True))
        now = streaks(sorted(known.items()), before)
        changed = [(d, n) for d, n in now if was.get(d) != n]
        if self.keep is not None:
            first = now[-1][0] - self.keep
            closed = [n for d, n in now if d < first]
            before = closed[-1] if closed else before
            known = {d: h for d, h in known.items() if d >= first}
        order = sorted(known)
        self.state.update((order, [known[d] for d in order], before))
        yield pd.DataFrame({
            "model": key[0], "ds": pd.to_datetime([d for d, _ in changed], unit="D"), "streak": pd.Series([n for _, n in changed], dtype="int64"),
            "action": ["AUTO_RETRAIN" if n >= self.days else "MONITOR" for _, n in changed],
        })

    def close(self) -> None:
        pass


def ordered_streaks(daily: DataFrame, limit: float = K.MAPE_ALERT_PCT, days: int = K.RETRAIN_DAYS, keep: int | None = None) -> DataFrame:
    """(model, ds, streak, action) for a stream of daily errors in any order; the newest row of a day holds.

    ``keep`` bounds how many days before the newest one may still be corrected; None corrects them all.
    """
    return daily.groupBy("model").transformWithStateInPandas(
        OrderedStreaks(limit, days, keep), "model string, ds timestamp, streak long, action string", "Update", "None"
    )


# ---- newest features -------------------------------------------------------------------------------------------


def lookup(spark: SparkSession, checkpoint: str, ids: list[str] | None = None) -> DataFrame:
    """Newest value per series, read from the state of a ``latest_values`` stream; nothing but the state is stored."""
    state = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    out = state.select(F.col("key.unique_id").alias("unique_id"), F.col("value.ds").alias("ds"), F.col("value.y").alias("y"))
    return out if ids is None else out.where(F.col("unique_id").isin(ids))


