"""Vectors against brute force over many pivots and blocks, with every kind of vector that can't be compared."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession

pytest.importorskip("corpusloom.llm")

from corpusloom.llm import vector_join  # noqa: E402


def expected(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """By vec_id the number of linked rows and the smallest reachable id, from all pairs."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    good = [(i, [c / max(map(abs, v)) for c in v]) for i, v in usable]
    links: dict[int, set[int]] = {i: set() for i, _ in rows}
    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and math.fsum(a * b for a, b in zip(x, y, strict=True)) >= 0.9 * math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y)):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()] - seen:
                seen.add(j)
                open_.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("config", [vector_join.Config(), vector_join.Config(cell=16, natives=7, members=11, directions=3)])
def test_all_pairs(spark: SparkSession, config: vector_join.Config) -> None:
    rng = random.Random(9)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors: list[list[float | None] | None] = [[c + rng.gauss(0, 0.4) for c in centre[i % 12]] for i in range(400)]
    vectors += [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8]
    vectors += [[1.0] * 7, [1.0] * 6 + [1.1], [5.0], [1e308] * 8, [1e-320] * 8]
    rows = list(enumerate(vectors))
    assert config.cell > 1000 or len(rows) // config.cell >= 20
    # Extra columns with the names of inner ones.
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, rep long, cell string").repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_duplicates(table, config).collect()}
    assert found == expected(rows)


def test_empty_and_without_ids(spark: SparkSession) -> None:
    schema = "vec_id long, embedding array<float>"
    assert vector_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 2.0]), (3, [1.0, 2.0]), (2**60 + 1, [1.0, 2.0]), (2**60 + 3, [2.0, -1.0])]
    found = sorted(map(tuple, vector_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(None, 0, None, True), (3, 1, 3, True), (2**60 + 1, 1, 3, False), (2**60 + 3, 0, 2**60 + 3, True)], key=str)
