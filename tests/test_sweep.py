"""Sweeps over boundaries against plain counting, and plans without pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from corpusloom.operators import sweep
from corpusloom.operators.ranges import uncovered


def made(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    reach = rng.choice([5, 50, 5000])
    spans = []
    for _ in range(rng.randint(0, 300)):
        a = rng.randint(-reach, reach)
        # A third belong to one source, some repeat, some end before they begin or have a null.
        spans.append((rng.choice(["hot", None, *"abcdefg", "hot", "hot"]), a, rng.choice([a, a + rng.randint(0, reach), a - 2, None, a + 3 * reach])))
    spans += spans[:20]
    points = [(i, rng.choice([None, rng.randint(-3 * reach, 6 * reach), rng.randint(-reach, reach)])) for i in range(200)]
    return spans, points


def plainly(spans: list[tuple], point: int | None) -> tuple[int, int]:
    hit = [s for s, a, b in spans if point is not None and a is not None and b is not None and a <= point <= b]
    return len({(s is None, s) for s in hit}), len(hit)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("buckets", [7, 1024])
def test_counts(spark: SparkSession, seed: int, buckets: int) -> None:
    spans, points = made(seed)
    i = spark.createDataFrame(spans, "who string, a long, b long").repartition(3)
    p = spark.createDataFrame(points, "id int, at long")
    own = sweep.covered(p, i, "at", "a", "b", "who", "sources", buckets)
    both = sweep.covered(own, i, "at", "a", "b", None, "all", buckets)
    assert sorted(tuple(r) for r in both.collect()) == sorted(((n, at, *plainly(spans, at)) for n, at in points), key=lambda r: r[0]) or {r.id: (r["sources"], r["all"]) for r in both.collect()} == {n: plainly(spans, at) for n, at in points}
    assert {r.id for r in uncovered(p, i, "at", "a", "b").collect()} == {n for n, at in points if not plainly(spans, at)[1]}


def test_no_pair_of_point_and_interval_is_made(spark: SparkSession) -> None:
    i = spark.range(1000).selectExpr("id % 7 as who", "id as a", "id + 500 as b")
    p = spark.range(0, 2000, 5).withColumnRenamed("id", "at")
    df = sweep.covered(p, i, "at", "a", "b", "who")
    rows = {r.at: r.n for r in df.collect()}
    assert rows[0] == 1 and rows[500] == 7 and rows[1995] == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
