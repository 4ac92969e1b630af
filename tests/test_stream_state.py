"""State on streams: caps and breakers as plain loops give them, state that leaves after its time, and restarts."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

from corpusloom.streaming import windows

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def stores(spark: SparkSession):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    windows.settings(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def write(spark: SparkSession, rows: list[tuple], path: Path, name: str) -> None:
    """One file, so one batch of those that come after."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / name))


def run(spark: SparkSession, df_of, path: Path, names: list[str]) -> list[tuple]:
    """Runs what has come in so far to its end, from where it was stopped."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in-*"))
    q = df_of(stream).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    state = [s for p in q.recentProgress for s in p["stateOperators"]]
    run.rows = state[-1]["numRowsTotal"] if state else 0
    return [tuple(r) for r in spark.read.parquet(str(path / "out")).collect()]


def plain_caps(rows: list[tuple], per_minute: int, per_day: int) -> dict[int, str]:
    minute: dict = {}
    day: dict = {}
    out = {}
    for i, user, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        m, d = (user, ts.replace(second=0, microsecond=0)), (user, ts.date())
        minute[m] = minute.get(m, 0) + 1
        if minute[m] > per_minute:
            out[i] = "minute"
            continue
        day[d] = day.get(d, 0) + 1
        out[i] = "day" if day[d] > per_day else "ok"
    return out


def test_caps_restart_and_expiry(spark: SparkSession, tmp_path: Path) -> None:
    rng = random.Random(1)
    rows = [(i, i % 3, START + dt.timedelta(seconds=6 * i + rng.randint(0, 5)), "click") for i in range(400)]
    of = lambda s: windows.capped_stream(s, 2, 25, late="10 minutes")
    write(spark, rows[:200], tmp_path, "in-1")
    run(spark, of, tmp_path, [])
    # The second run goes on counting where the first was stopped.
    write(spark, rows[200:], tmp_path, "in-2")
    got = {r[1]: r[3] for r in run(spark, of, tmp_path, [])}
    assert got == plain_caps(rows, 2, 25) and set(got.values()) == {"ok", "minute", "day"}
    held = run.rows
    assert held > 30
    # Three days on, nothing of the first day is left; counting begins anew.
    later = [(1000 + i, i % 3, START + dt.timedelta(days=3, seconds=30 * i), "click") for i in range(30)]
    write(spark, later[:15], tmp_path, "in-3")
    run(spark, of, tmp_path, [])
    write(spark, later[15:], tmp_path, "in-4")
    got = {r[1]: r[3] for r in run(spark, of, tmp_path, []) if r[1] >= 1000}
    assert got == plain_caps(later, 2, 25) and run.rows < held / 2


def test_breaker_opens_and_closes_by_timer(spark: SparkSession, tmp_path: Path) -> None:
    kinds = ["click", "error", "error", "click", "error", "error", "error", "error", "click"]
    rows = [(i, 1, START + dt.timedelta(minutes=i), k) for i, k in enumerate(kinds)] + [(100 + i, 2, START + dt.timedelta(minutes=i), "error") for i in range(2)]
    of = lambda s: windows.broken_stream(s, 3, 30 * 60_000, late="1 minute")
    write(spark, rows, tmp_path, "in-1")
    assert [r[:2] for r in run(spark, of, tmp_path, [])] == [(1, "open")]
    # An hour later the watermark has passed the rest; the run of failures begins anew.
    write(spark, [(200, 3, START + dt.timedelta(hours=1), "click")], tmp_path, "in-2")
    run(spark, of, tmp_path, [])
    write(spark, [(201, 1, START + dt.timedelta(hours=1, minutes=1), "error"), (202, 1, START + dt.timedelta(hours=1, minutes=2), "error")], tmp_path, "in-3")
    out = sorted(run(spark, of, tmp_path, []), key=lambda r: r[2])
    assert [(r[0], r[1], r[2]) for r in out] == [(1, "open", START + dt.timedelta(minutes=6)), (1, "closed", START + dt.timedelta(minutes=36))]


def test_table_function(spark: SparkSession) -> None:
    from corpusloom.operators import table_functions

    table_functions.register(spark)
    rows = [(1, 5, "text", 0.5), (1, 5, "vector", 0.5), (1, 6, "text", 0.9), (1, 7, "vector", 0.6), (1, 7, "vector", 0.4), (1, None, "text", 9.0), (1, 8, "text", None), (2, 5, "vector", 0.1), (None, 3, "text", 0.5), (1, 4, "text", 0.9)]
    spark.createDataFrame(rows, "qid int, id long, list string, score double").createOrReplaceTempView("candidates")
    call = "select * from hybrid_search(table(select * from candidates where {}) {}, k => 3, text_weight => 0.4, vector_weight => 0.6)"
    got = sorted((tuple(r) for r in spark.sql(call.format("true", "partition by qid")).collect()), key=repr)
    # 7's higher vector score counts; 4, 6 and 7 are level, and the smaller ids come first.
    assert [(r[0], r[1], r[2], round(r[5], 6)) for r in got] == [(1, 4, 2, 0.36), (1, 5, 1, 0.5), (1, 6, 3, 0.36), (2, 5, 1, 0.06), (None, 3, 1, 0.2)]
    assert [tuple(r)[:3] for r in spark.sql(call.format("qid = 2", "partition by qid")).collect()] == [(2, 5, 1)]
    assert spark.sql(call.format("false", "partition by qid")).collect() == []
    with pytest.raises(Exception, match="k must be"):
        spark.sql(call.replace("k => 3", "k => 0").format("true", "partition by qid")).collect()
