"""The vector index against brute force: exact answers, filters, recall, odd rows, and the files that a search reads."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as V
from corpusloom.operators.retrieval import nearest_each
from corpusloom.session import table

SF = "/root/testdata/sf0.1"


def plainly(rows: list[tuple], queries: list[tuple], k: int, fits=lambda r: True) -> dict[int, list[int]]:
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    out = {}
    for qid, _, q in queries:
        scored = sorted((-round(float(unit(q) @ unit(v)), 12), i) for i, label, v in rows if i != qid and fits((i, label)))
        out[qid] = [i for _, i in scored[:k]]
    return out


def got(df: DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, -round(r.score, 12), r.vec_id)):
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def made(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> tuple[list[tuple], DataFrame, V.Index]:
    """Clustered vectors, a third of them copies of one, with ties."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8))
    v = [(centre[rng.integers(12)] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist() for _ in range(400)]
    v += [v[0]] * 200
    rows = [(i, int(rng.integers(5)), x) for i, x in enumerate(v)]
    odd = [(1000, 1, None), (1001, 1, [0.0] * 8), (1002, 1, [1.0, 2.0]), (1003, 1, [float("nan")] + [1.0] * 7), (1004, 1, [None] + [1.0] * 7), (1005, 1, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").repartition(4)
    return rows, df, V.build(df, str(tmp_path_factory.mktemp("index")), ("label",), V.Config(lists=20, file_rows=100))


@pytest.mark.parametrize("k", [1, 7, 300])
def test_exact(made, k: int) -> None:
    rows, df, index = made
    asked = rows[:: 40]
    found = got(V.search(index, df.where("vec_id % 40 = 0 and vec_id < 600"), k, exact=True, probes=1, block=4, chunk_rows=50))
    assert found == plainly(rows, asked, k)


def test_filtered_search_widens_until_it_has_k_rows(made) -> None:
    rows, df, index = made
    asked = rows[:: 50]
    q = df.where("vec_id % 50 = 0 and vec_id < 600")
    fits = lambda r: r[1] == 2 and r[0] % 3 == 0
    where = (F.col("label") == 2) & (F.col("vec_id") % 3 == 0)
    assert got(V.search(index, q, 5, where, probes=1, exact=True)) == plainly(rows, asked, 5, fits)
    near = got(V.search(index, q, 30, where, probes=1))
    assert {i: len(x) for i, x in near.items()} == {i: min(30, len(x)) for i, x in plainly(rows, asked, 30, fits).items()}
    few = got(V.search(index, q, 10_000, where, probes=1))
    assert few == plainly(rows, asked, 10_000, fits)
    assert got(V.search(index, q, 5, F.lit(False))) == {}


def test_radius_and_codes_bound_what_they_leave_out() -> None:
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = V.fit_centres(x, 10, 5, 1)
    own, dot, scale, codes = V.encoded(x, centres)
    back = centres[own] + codes * (scale / 127)[:, None]
    assert (np.linalg.norm(x - back, axis=1) <= scale * 4 / 254 + 1e-12).all()
    assert np.allclose(dot, (x * centres[own]).sum(1)) and (own == (x @ centres.T).argmax(1)).all()


def test_recall_and_files_read(spark: SparkSession, tmp_path) -> None:
    e = table(spark, SF, "embeddings").select("vec_id", "label", "embedding")
    index = V.build(e, str(tmp_path / "i"), ("label",))
    q = e.where("vec_id % 100 = 0")
    best = got(nearest_each(e.select("vec_id", "embedding"), q.select("vec_id", "embedding"), 10))
    near = got(V.search(index, q, 10))
    recall = np.mean([len(set(near[i]) & set(best[i])) / 10 for i in best])
    assert recall >= 0.9 and index.probes < len(index.rows), (recall, index.probes, len(index.rows))
    print('recall', recall, 'of', index.probes, 'of', len(index.rows), 'lists')
    # A scan for some lists reads only their files, and codes without vectors.
    plan = index.lists(spark).where(F.col("list").isin([1, 2])).select("list", "vec_id", "scale", "code")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*list.*IN \(1,2\)", plan) and "embedding" not in re.search(r"ReadSchema: (.*)", plan)[1]
    again = V.Index.opened(spark, index.path)
    assert got(V.search(again, q.limit(3), 5, exact=True)) == {i: best[i][:5] for i in sorted(got(V.search(again, q.limit(3), 5)))}


def test_nothing_to_index(spark: SparkSession, tmp_path) -> None:
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    index = V.build(none, str(tmp_path / "i"))
    assert V.search(index, none, 3).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    index = V.build(one, str(tmp_path / "j"))
    assert V.search(index, one, 3).collect() == []
    other = spark.createDataFrame([(9, [2.0, 0.0]), (8, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.qid, r.vec_id, round(r.score, 9)) for r in V.search(index, other, 3).collect()] == [(9, 1, 1.0)]
