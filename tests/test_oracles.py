"""Each registered query gives the rows of its SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest
from oracle import duck_rows, spark_rows
from pyspark.sql import SparkSession

from corpusloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_of_sql(spark: SparkSession, name: str) -> None:
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_runs(spark: SparkSession, name: str) -> None:
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    assert len(set(df.columns)) == len(df.columns)
