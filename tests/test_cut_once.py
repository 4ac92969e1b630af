"""Texts that several parts of a query need are cut once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

from corpusloom import catalog
from corpusloom.operators import editions

SF = "/root/testdata/sf0.001"


def test_rows_of_editions_are_made_once(spark: SparkSession) -> None:
    made = spark.sparkContext.accumulator(0)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made.add(len(frame))
            yield frame

    held = [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("b", 1, "x"), ("c", 2, "z"), ("d", 2, None)]
    schema = "edition string, passage long, shingle string"
    rows = spark.createDataFrame(held, schema).coalesce(1).mapInPandas(counted, schema)
    found = {r.edition: (r.family, r.united, r.largest) for r in editions.families(rows, 0.02).collect()}
    assert found == {"a": ("a", 2, 2), "b": ("a", 2, 2), "c": ("c", 1, 1), "d": ("d", 0, 0)}
    assert made.value == len(held)
    made.value = 0
    assert {(r.edition, r.other): r.likeness for r in editions.likeness(rows).collect()} == {("a", "b"): 0.5, ("c", "d"): 0.0}
    assert made.value == len(held)


def test_threshold_sweep_reads_each_table_once(spark: SparkSession) -> None:
    plan = catalog.QUERIES["match_threshold_sweep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
