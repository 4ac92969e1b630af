"""Vectors of an index do not pass through the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as V


def test_rounds_merge_vectors_and_open_the_lists_once(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = spark.range(1, 301).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("embedding"))
    index = V.build(rows, str(tmp_path / "v"), config=V.Config(lists=12))
    plans, opened = [], []
    scored, lists = V._scored, V.Index.lists
    monkeypatch.setattr(V, "_scored", lambda *a: plans.append(scored(*a)) or plans[-1])
    monkeypatch.setattr(V.Index, "lists", lambda self, s: opened.append(1) or lists(self, s))
    found: DataFrame = V.search(index, rows.where("vec_id % 100 = 0"), 5, exact=True)
    assert found.count() == 15 and len(opened) == 1
    for df in plans:
        joins = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [list#" in joins and not any("BroadcastHashJoin" in line and "vec_id" in line for line in joins.split("\n"))
