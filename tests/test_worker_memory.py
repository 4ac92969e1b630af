"""What a Python worker holds at once is bounded, whatever a task has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalize
from corpusloom.operators import chunking, postings


@pytest.fixture
def counts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> tuple:
    """Batches that go into functions of Arrow batches, and that come out of them."""
    into, out = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    frame = type(spark.range(1))
    plain = frame.mapInArrow

    def counted(self, f, schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def seen() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    into.add(1)
                    yield b

            for b in f(seen()):
                out.add(1)
                yield b

        return plain(self, run, schema)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    return into, out


def test_index_is_built_from_small_batches(spark: SparkSession, counts: tuple, tmp_path) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    texts = spark.range(0, 3000, 1, 1).select("id", F.lit("the quick fox").alias("text"))
    index = postings.build(texts, str(tmp_path / "i"), ("id",), F.col("text"))
    assert counts[0].value >= 3 and spark.conf.get(setting, None) == before
    assert postings.search(index, spark, "quick").rows.count() == 3000


def test_pieces_come_a_few_rows_at_a_time(spark: SparkSession, counts: tuple) -> None:
    texts = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.lit("One. Two.")).alias("text"))
    rows = chunking.chunked(texts, "id", chunking.sentences).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 0, None, "One. Two.") for i in range(0, 1000, 2)]
    assert counts[1].value >= 1000 // chunking._ROWS


def test_normal_forms_of_many_rows_keep_their_places() -> None:
    n = 3 * normalize._ROWS + 1
    texts = pa.array([None if i % 5 == 0 else f"Row, {i}!" for i in range(n)])
    assert normalize._by_rows(normalize.normal, texts).to_pylist() == [None if i % 5 == 0 else f"row {i}" for i in range(n)]
    assert normalize._by_rows(normalize.normal, pa.array([], pa.string())).to_pylist() == []
