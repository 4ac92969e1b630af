"""Tables kept under the name of the files they were made from."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from corpusloom.operators import matching
from corpusloom.operators.stored import stored
from corpusloom.session import table

SF = "/root/testdata/sf0.001"


def test_made_once_for_each_state_of_the_files(spark: SparkSession, tmp_path: Path) -> None:
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    made = []
    of = lambda said="x": stored(spark.read.parquet(path), said, made.append, "test")
    first = of()
    assert of() == first and made == [first]
    assert of("y") != first and len(made) == 2
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert of() != first and len(made) == 3


def test_cut_off_makers_are_called_again(spark: SparkSession, tmp_path: Path) -> None:
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)

    def broken(_: str) -> None:
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        stored(spark.read.parquet(path), "x", broken, "test")
    made: list[str] = []
    stored(spark.read.parquet(path), "x", made.append, "test")
    assert len(made) == 1


def test_passages_are_cut_once(spark: SparkSession) -> None:
    passages = table(spark, SF, "benchmark")
    kept = matching.stored_passages(passages, "item_id")
    rows = lambda df: sorted(tuple(r) for r in df.select("item_id", "shingle", "h").collect())
    assert rows(kept) == rows(matching.passage_index(passages, "item_id"))
    read = matching.uncited_matches(table(spark, SF, "documents"), kept, "doc_id", "item_id").inputFiles()
    assert any("passages-" in f for f in read) and not any("benchmark" in f for f in read)
