"""One document's walk through the queue, its failures and its end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming import queue

NOW = dt.datetime(2024, 5, 1, 12)
SCHEMA = "user_id int, doc_id int, status string, claimed_at timestamp, created_at timestamp, attempts int, parse_error string"


def at() -> Column:
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    ago = lambda m: None if m is None else NOW - dt.timedelta(minutes=m)
    return spark.createDataFrame([(u, d, s, ago(c), ago(m), a, e) for u, d, s, c, m, a, e in rows], SCHEMA)


def test_claims(spark: SparkSession) -> None:
    d = documents(spark, [
        (1, 1, "queued", None, 10, 0, None), (1, 2, "queued", None, 20, 0, None), (1, 3, "parsing", 30, 40, 1, None),
        (2, 4, "parsing", 6, 9, 1, None), (2, 5, "queued", 8, 30, 1, None), (3, 6, "parsing", 2, 3, 1, None), (3, 7, "queued", None, 3, 3, None),
        (4, 8, "ready", 60, 90, 1, None),
    ])
    found = {r.doc_id: r for r in queue.claimed(d, at()).collect()}
    # Never claimed and older first; then a dead worker's; live ones, used-up ones and finished ones stay.
    assert sorted(i for i, r in found.items() if r.taken) == [2, 5]
    assert (found[2].status, found[2].attempts, found[2].claimed_at) == ("parsing", 1, NOW)
    assert (found[6].status, found[6].attempts) == ("parsing", 1)
    assert found[8].status == "ready"


def test_walk_to_the_end(spark: SparkSession) -> None:
    d = documents(spark, [(1, 1, "queued", None, 10, 0, None)])
    for attempt in range(1, queue.MOST_ATTEMPTS + 1):
        taken = queue.claimed(d, at()).where("taken")
        results = taken.withColumns({"stored": F.lit(True), "refusal": F.lit(None).cast("string"), "chunks": F.lit(0), "error": F.lit("boom"), "permanent": F.lit(False)})
        row = queue.outcome(results).first()
        assert (row.attempts, row.status) == (attempt, "queued" if attempt < queue.MOST_ATTEMPTS else "failed")
        d = queue.outcome(results).select(d.columns)


def test_reaper(spark: SparkSession) -> None:
    d = documents(spark, [(1, 1, "embedding", 6, 60, 3, "no memory"), (1, 2, "embedding", 6, 60, 2, None), (1, 3, "embedding", 1, 60, 3, None), (1, 4, "parsing", 9, 60, 3, None)])
    found = {r.doc_id: (r.status, r.parse_error) for r in queue.reaped(d, at()).collect()}
    assert found[1] == ("failed", "Gave up after 3 attempts. The last error was: no memory")
    assert found[2] == ("embedding", None) and found[3] == ("embedding", None)
    assert found[4] == ("failed", "Gave up after 3 attempts. The last error was: unknown")


def test_breaker(spark: SparkSession) -> None:
    rows = [("a", i, c, False, False, 1) for i, c in enumerate([None] * 20 + ["x", "x", "x"])]
    rows += [("b", i, c, False, False, 1) for i, c in enumerate(["x", None, "y", None])]
    rows += [("c", i, None, i < 30, False, 1) for i in range(40)] + [("d", 0, None, False, True, 1), ("e", 0, "x", False, False, 1)]
    found = {r.run_id: (r.breaker, r.action) for r in queue.breaker(spark.createDataFrame(rows, "run_id string, seq int, code string, staged boolean, rate_limited boolean, elapsed int")).collect()}
    assert found == {"a": ("consecutive-failure", "halt"), "b": ("quarantine-rate", "halt"), "c": ("staged-backlog", "pause"), "d": ("budget", "pause")}
