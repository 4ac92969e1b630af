"""Tasks get no larger with the table: more of them are made, and no group is sorted whole where its units can be."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gates, relational, selection
from corpusloom.queries import small


@pytest.mark.parametrize("made", ["diverse", "flattened"])
def test_tasks_grow_with_rows(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, made: str) -> None:
    n = 400_000
    k = F.col("id")
    if made == "diverse":
        e = spark.range(n).select((k % 5000).alias("g"), k.alias("position"), (k % 4).alias("author"), F.lit("").alias("tradition"), (k % 1900).cast("int").alias("year"))
        df = selection.diverse(e, 3, ["g"])
    else:
        lines = spark.range(n).select((k % 5000).alias("l_orderkey"), k.alias("l_partkey"), k.alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit("N").alias("l_returnflag"))
        monkeypatch.setattr(small, "table", lambda *_: lines)
        df = small.flattened_marks(spark, "")
    tasks = [int(x) for x in re.findall(r"hashpartitioning\([^)]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]
    assert tasks and min(tasks) >= 2


def test_page_furniture_by_unit_is_that_of_the_whole_group(spark: SparkSession) -> None:
    texts = [("a", 1, "Head\n\n12\nline of text here it is"), ("a", 2, ""), ("a", 3, "Guide"), ("a", 4, "\nGuide two"), ("a", 5, "kept words\nGuide"), ("b", 6, "Alone"), (None, 7, "Alone"), (None, 8, "x\n\nEntry one\n\n")]
    texts += [("a", 20 + i, "often\n") for i in range(10)] + [("b", 40 + i, "nine times") for i in range(9)]
    rows = spark.createDataFrame(texts, "source string, doc long, text string")
    lines = rows.select("source", "doc", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("position", F.struct("doc", "p"))
    opens = F.col("line").startswith("Entry")
    by_unit = gates.without_chrome(lines, ["source"], opens, position="p", unit="doc")
    of = lambda df: {(r.doc, r.p): r["class"] for r in df.collect()}
    found = of(by_unit)
    assert found == of(gates.without_chrome(lines, ["source"], opens))
    assert found[1, 0] == "guide" and found[3, 0] == "guide" and found[5, 1] == "kept"
    assert {found[20 + i, 0] for i in range(10)} == {"frequent"} and "frequent" not in {found[40 + i, 0] for i in range(9)}
    assert found[6, 0] == "kept" and found[7, 0] == "kept" and found[8, 2] == "kept" and found[1, 2] == "page_number"


def test_tasks_follow_the_estimate(spark: SparkSession) -> None:
    df = spark.range(4_000_000)
    assert relational.spread(df, "id", megabytes=1.0).rdd.getNumPartitions() >= 30
    assert relational.spread(df.limit(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
