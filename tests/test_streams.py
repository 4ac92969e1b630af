"""Counters and logs as running streams give what the tables give, restarts and repeated delivery included."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming import counters, queue

SCHEMA = "event_id long, user_id long, ts timestamp"


def events(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i % 5, start + dt.timedelta(minutes=7 * i)) for i in range(first, first + n)], SCHEMA)


def finished(df: DataFrame, path: Path, mode: str) -> None:
    q = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None


def test_windows_of_a_stream(spark: SparkSession, tmp_path: Path) -> None:
    rows = events(spark, 400)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    # A last event, far ahead, closes the windows before it.
    spark.createDataFrame([(10_000, 9, dt.datetime(2024, 3, 1))], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    finished(counters.windowed(stream, "1 hour", late="1 day"), tmp_path / "out", "append")
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "user_id", "n").collect()}
    assert found == {tuple(r) for r in counters.windowed(rows, "1 hour").select("start", "user_id", "n").collect()}


def test_active_days_count_once(spark: SparkSession, tmp_path: Path) -> None:
    rows = events(spark, 300)
    rows.union(rows).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    finished(counters.daily_active(stream), tmp_path / "out", "append")
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "day").collect()]
    assert sorted(found) == sorted({tuple(r) for r in rows.select("user_id", F.date_trunc("day", "ts").alias("day")).collect()})


def test_log_of_a_stream_survives_restarts(spark: SparkSession, tmp_path: Path) -> None:
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    for first in (0, 40):
        events(spark, 40, first).write.mode("append").parquet(source)
        for _ in range(2):
            q = queue.stream_log(spark.readStream.schema(SCHEMA).parquet(source), log, state, lambda df: df.select("event_id", "ts"))
            assert q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(log).collect()) == list(range(80))


def test_a_log_that_cannot_be_written(spark: SparkSession, tmp_path: Path) -> None:
    rows = events(spark, 3)
    (tmp_path / "file").write_text("not a folder")
    assert not queue.append_log(rows, str(tmp_path / "file"))
    assert queue.append_log(rows, str(tmp_path / "log"))
    assert queue.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_caps(spark: SparkSession) -> None:
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(i, u, start + dt.timedelta(seconds=10 * i)) for i in range(12) for u in (1, 2)]
    found = counters.capped(spark.createDataFrame([(2 * i + u, u, t) for i, u, t in rows], SCHEMA), per_minute=4, per_day=6, in_all=10).orderBy("ts", "event_id").collect()
    by_user = {u: [r.verdict for r in found if r.user_id == u] for u in (1, 2)}
    # Four of the first six in the minute, two more in the next until the day's six; ten of all users' twelve.
    assert by_user[1] == ["ok"] * 4 + ["minute"] * 2 + ["ok"] + ["global"] + ["day"] * 2 + ["minute"] * 2
    assert by_user[2] == ["ok"] * 4 + ["minute"] * 2 + ["ok"] + ["global"] + ["day"] * 2 + ["minute"] * 2
