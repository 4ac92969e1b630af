"""Counters, caps and breakers on streams whose state leaves by itself.

Each is a stateful processor over event time: it keeps what it needs for each key, sets a
timer for when that can no longer matter, and removes it when the watermark passes the timer. A stream that is
stopped goes on from its checkpoint with the state that is left. The state store
must be one with column families: settings() names Spark's own.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 24 * 3600 * 1000
VERDICTS = "user_id long, event_id long, ts timestamp, verdict string"


def settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(t: pd.Timestamp) -> int:
    return int(t.tz_localize("UTC").timestamp() * 1000) if t.tzinfo is None else int(t.timestamp() * 1000)


class Caps(StatefulProcessor):
    """Verdicts on a user's events: "minute" beyond per_minute of one minute, "day" beyond per_day of one day (those that their minute refuses don't count), else "ok".

    Events come in the order of a batch's time and event_id. A window's counter is removed `keep_ms` after the window began; events of
    a removed window are late, get "late", and count for nothing.
    """

    def __init__(self, per_minute: int, per_day: int, keep_ms: int = 2 * DAY_MS):
        self.per_minute, self.per_day, self.keep = per_minute, per_day, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bucket string, start long", "n int")

    def _count(self, bucket: str, start: int) -> int:
        found = self.counts.getValue((bucket, start)) if self.counts.containsKey((bucket, start)) else None
        return int(found[0]) if found else 0

    def _add(self, bucket: str, start: int, n: int) -> None:
        if n == 0:
            self.handle.registerTimer(start + self.keep)
        self.counts.updateValue((bucket, start), (n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        said = []
        for ts in events["ts"]:
            at = _ms(ts)
            minute, day = at - at % 60_000, at - at % DAY_MS
            if min(minute, day) + self.keep <= timerValues.getCurrentWatermarkInMs():
                said.append("late")
                continue
            in_minute = self._count("minute", minute)
            self._add("minute", minute, in_minute)
            if in_minute >= self.per_minute:
                said.append("minute")
                continue
            in_day = self._count("day", day)
            self._add("day", day, in_day)
            said.append("day" if in_day >= self.per_day else "ok")
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"].to_numpy(), "ts": events["ts"].to_numpy(), "verdict": said})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        for bucket in ("minute", "day"):
            if self.counts.containsKey((bucket, start)):
                self.counts.removeKey((bucket, start))
        return iter(())

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """Opens for a key when `failures` events of kind "error" come in a row, and closes `rest_ms` of event time later by a timer: rows (key, state, at)."""

    def __init__(self, failures: int, rest_ms: int):
        self.failures, self.rest = failures, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "n int, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        n, is_open = self.run.get() if self.run.exists() else (0, False)
        out = []
        for ts, kind in zip(events["ts"], events["event_type"], strict=True):
            n = n + 1 if kind == "error" else 0
            if n >= self.failures and not is_open:
                is_open = True
                self.handle.registerTimer(_ms(ts) + self.rest)
                out.append((key[0], "open", ts))
        if n or is_open:
            self.run.update((int(n), bool(is_open)))
        elif self.run.exists():
            self.run.clear()
        yield pd.DataFrame(out, columns=["user_id", "state", "at"]).astype({"at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, datetime.UTC).replace(tzinfo=None)
        yield pd.DataFrame({"user_id": [key[0]], "state": ["closed"], "at": pd.to_datetime([at]).astype("datetime64[ns]")})

    def close(self) -> None:
        pass


def capped_stream(events: DataFrame, per_minute: int, per_day: int, late: str = "10 minutes", keep_ms: int = 2 * DAY_MS) -> DataFrame:
    """(user_id, event_id, ts, verdict) of a stream (user_id, event_id, ts); see Caps."""
    rows = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Caps(per_minute, per_day, keep_ms), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")


def broken_stream(events: DataFrame, failures: int, rest_ms: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, state, at) of a stream (user_id, event_id, ts, event_type); see Breaker."""
    rows = events.select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Breaker(failures, rest_ms), outputStructType="user_id long, state string, at timestamp", outputMode="Append", timeMode="EventTime")
