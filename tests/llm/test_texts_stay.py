"""Leaving out documents by id moves few of the texts that stay, and none is lost."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

jaccard_join = pytest.importorskip("corpusloom.llm.jaccard_join")


@pytest.mark.parametrize("most", [1024, 1])
def test_rows_that_travel(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, most: int) -> None:
    monkeypatch.setattr(jaccard_join, "ROWS", most)
    docs = spark.range(-1000, 39_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, None), (None, "x"), (7, "again"), (8, "again")], "doc_id long, text string"))
    ids = docs.where("doc_id % 10 = 7").select("doc_id").distinct()
    staying, asked = jaccard_join.parted(docs, ids)
    stay, ask = staying.collect(), asked.collect()
    assert sorted(map(str, stay + ask)) == sorted(map(str, docs.collect()))
    assert not {r.doc_id for r in ids.collect()} & {r.doc_id for r in stay}
    assert len(ask) < (0.2 if most > 1 else 0.3) * docs.count()


def test_no_ids(spark: SparkSession) -> None:
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    staying, asked = jaccard_join.parted(docs, docs.where("doc_id > 9").select("doc_id"))
    assert staying.count() == 5 and asked.count() == 0


def test_one_of_each_without_broadcasts(spark: SparkSession) -> None:
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(c), F.floor(F.col("id") / 2)) for c in "abcdefgh"]).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard_join.one_of_each(docs)
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, 300, 2))
        # Which texts stay is told before any moves: no anti join was pushed below the one with the bits.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_bits" in plan and "LeftAnti" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
