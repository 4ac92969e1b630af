"""Embedding in batches: what is there already is skipped, failed batches are set apart, counts are true.

The embedder and the store are given from outside; all that is asked of them is in the protocols below.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import sinks


class Embedder(Protocol):
    """Vectors of texts, one each, by one named model. It goes to the tasks, so it must pickle."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Store(Protocol):
    """A place for rows with a key."""

    def upsert(self, rows: DataFrame) -> tuple[int, int]:
        """(inserted, skipped): rows whose key is there already are skipped."""
        ...


class ParquetStore:
    """A table of Parquet files as a store."""

    def __init__(self, path: str, key: list[str]):
        self.path, self.key = path, key

    def upsert(self, rows: DataFrame) -> tuple[int, int]:
        return sinks.insert_new(rows, self.path, self.key)


class SourceAdapter(Protocol):
    """Texts of a source by the verse they are on."""

    def verses(self) -> DataFrame:
        """(verse_id, text)."""
        ...


class DailySource(Protocol):
    """What is read on a day."""

    def pick(self, days: DataFrame) -> DataFrame:
        """days (date, half) with the passage (start, end) that leads each."""
        ...


def missing(docs: DataFrame, stored: DataFrame | None, key: list[str]) -> DataFrame:
    """The documents whose key isn't stored."""
    return docs if stored is None else docs.join(stored.select(*key).distinct(), key, "left_anti").select(docs.columns)


def _attempts(embedder: Embedder, texts: list[str], tries: int, wait: float, retry: Callable[[Exception], bool]) -> list[list[float]]:
    for k in range(tries):
        try:
            return embedder.embed(texts)
        except Exception as fault:
            if k == tries - 1 or not retry(fault):
                raise
            time.sleep(wait * 2**k)
    return []


def _whole(embedder: Embedder, texts: list[str], too_long: Callable[[Exception], bool], attempt: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
    """Vectors of all texts; one that is too long is the mean of its halves' vectors at length 1, so that nothing of it is dropped."""
    try:
        return attempt(texts)
    except Exception as fault:
        if not too_long(fault) or (len(texts) == 1 and len(texts[0]) < 2):
            raise
    if len(texts) > 1:
        middle = -(-len(texts) // 2)
        return _whole(embedder, texts[:middle], too_long, attempt) + _whole(embedder, texts[middle:], too_long, attempt)
    middle = -(-len(texts[0]) // 2)
    mean = np.mean(_whole(embedder, [texts[0][:middle], texts[0][middle:]], too_long, attempt), axis=0)
    return [(mean / (np.linalg.norm(mean) or 1.0)).tolist()]


def embedded(
    docs: DataFrame, embedder: Embedder, batch: int = 64, tries: int = 3, wait: float = 0.5,
    retry: Callable[[Exception], bool] = lambda fault: True, too_long: Callable[[Exception], bool] = lambda fault: False,
) -> DataFrame:
    """docs (with text) with embedding, model and error: a batch that fails to the end has its reason, and no other is touched.

    How many workers run is the number of partitions; repartition docs to bound them.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = lambda texts: _attempts(embedder, texts, tries, wait, retry)
        for whole in batches:
            for begin in range(0, len(whole), batch):
                rows = whole.slice(begin, batch)
                try:
                    vectors, error = _whole(embedder, [t or "" for t in rows.column("text").to_pylist()], too_long, attempt), None
                    if len(vectors) != len(rows):
                        raise ValueError(f"{len(vectors)} vectors for {len(rows)} texts")
                except Exception as fault:
                    vectors, error = [None] * len(rows), f"{type(fault).__name__}: {fault}"
                added = [pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.model] * len(rows)), pa.array([error] * len(rows), pa.string())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *added], [*columns, "embedding", "model", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", embedding array<float>, model string, error string"
    return docs.mapInArrow(run, schema)


def ingest(docs: DataFrame, embedder: Embedder, store: Store, staging: str, **options: object) -> dict[str, int]:
    """Embed and store: (embedded, upserted, failed) counted from what was written, so a repeated run counts what is new only."""
    embedded(docs, embedder, **options).write.mode("overwrite").parquet(staging)
    rows = docs.sparkSession.read.parquet(staging)
    good = rows.where("error is null").drop("error")
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    inserted, _ = store.upsert(good)
    return {"embedded": counts.good, "upserted": inserted, "failed": counts.bad}


def one_model(rows: DataFrame, model: str) -> DataFrame:
    """rows, if all are of that model; an error names the others, as vectors of two models can't be compared."""
    others = sorted(r.model for r in rows.select("model").distinct().where(F.col("model") != model).limit(10).collect())
    if others:
        raise ValueError(f"vectors of other models than {model}: {others}")
    return rows
