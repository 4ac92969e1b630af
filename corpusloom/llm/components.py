"""Connected components of links between ids, as joins and groupings.

Links may be many and chains long, so nothing is collected: alternating large-
and small-star steps (Kiveris and others, "Connected Components in MapReduce and
Beyond") move each id's links to smaller ids until every component is a star
around its smallest id. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import written
from corpusloom.llm.words import tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component), for ids that are not smallest; a and b are linked pairwise."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        # Every root takes the smallest root it is linked with, then paths are halved until flat.
        px, py = parent[x], parent[y]
        low, high = np.minimum(px, py), np.maximum(px, py)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    other = parent != np.arange(len(ids))
    return ids[other], ids[parent[other]]


def _contracted(links: DataFrame) -> DataFrame:
    """The same components with fewer links: each partition's links become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += len(batch)
            if n > 1_000_000:  # what is held is at most one link an id after this
                held, n = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return links.mapInArrow(tidy(run), "a long, b long")


def _smallest(links: DataFrame) -> DataFrame:
    """A join rather than a window, as one id may have most links and skewed joins are split."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable. Links may repeat and point either way."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = written(_contracted(links), "links")
    while True:
        # Large star: an id's larger neighbours are linked with its smallest one.
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(_smallest(both), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # Small star: an id and its smaller neighbours are linked with the smallest of them.
        marked = large.join(_smallest(large), "a")
        small = marked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(marked.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "links")
        # Done when no id has two smaller neighbours and none is both larger and smaller: all are stars.
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("id"), F.col("b").alias("component")).union(after.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        links = after
