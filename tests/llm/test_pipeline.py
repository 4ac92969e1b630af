"""The pipeline and the trained stages: what each stage decides takes effect, odd rows included."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from corpusloom.llm import jaccard_join, quality, secrets, toxicity  # noqa: E402
from corpusloom.llm.shared import fold  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> list[DataFrame]:
    """The documents with odd rows added, and what each stage makes of its predecessor's."""
    where = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.where("doc_id = 0").drop("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (9_000_000_000, None), (9_000_000_001, ""), (9_000_000_002, " \n"), (9_000_000_003, None), (9_000_000_003, None)], "doc_id long, text string")
    copies = docs.where("doc_id in (3, 4)").withColumn("doc_id", F.col("doc_id") + 9_100_000_000)
    docs.unionByName(odd.crossJoin(plain).select(docs.columns)).unionByName(copies).repartition(3).write.parquet(str(where / "0"))
    out = [spark.read.parquet(str(where / "0"))]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, out[-1], SF).write.parquet(str(where / str(i)))
        out.append(spark.read.parquet(str(where / str(i))))
    return out


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def test_order_and_columns(stages: list[DataFrame]) -> None:
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "secrets", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.dtypes == stages[0].dtypes


def test_toxic_documents_go(spark: SparkSession, stages: list[DataFrame]) -> None:
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(stages[0], labels, fold(F.col("doc_id"), 3) != 1)
    rejected = {(r.doc_id, r.predicted) for r in toxicity.score(stages[0], model).collect()}
    gone = {d for d, p in rejected if p}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in gone]
    assert rejected


def test_low_quality_goes(spark: SparkSession, stages: list[DataFrame]) -> None:
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = fold(F.col("doc_id"), 4)
    scored = quality.fit_and_score(stages[1], labels, fit_rows=key.isin(0, 1), calibrate_rows=key == 3).collect()
    assert len(scored) == stages[1].count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    before, after = rows(stages[1]), rows(stages[2])
    assert set(after) <= set(before)
    assert len(after) < len(before)


def test_one_of_each_group_stays(stages: list[DataFrame]) -> None:
    found = {r.doc_id: r.component_id for r in jaccard_join.joined(stages[2]).where("doc_id is not null").collect()}
    kept = rows(stages[3])
    assert {d for d, _ in kept if d is not None} == {d for d, c in found.items() if d == c}
    assert len(kept) == len(set(kept))
    assert not [r for r in rows(stages[2]) if r[0] is None] or [r for r in kept if r[0] is None]


def test_secrets_are_masked(stages: list[DataFrame]) -> None:
    before, after = rows(stages[3]), rows(stages[4])
    assert [d for d, _ in before] == [d for d, _ in after]
    model = secrets.train(secrets.samples(stages[3]))
    left = secrets.scan(stages[4], model).agg(F.sum(F.col("n_access") + F.col("n_hex"))).first()[0]
    assert not left
    assert before != after


def test_all_that_is_left_is_packed(stages: list[DataFrame]) -> None:
    packed = stages[5].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows(stages[4]))
    assert sum(r.length for r in packed) == tokens
    places: dict[int, list[tuple[int, int]]] = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_writes_each_stage(spark: SparkSession) -> None:
    docs = corpus_pipeline.run(spark, SF)
    assert docs.count() > 0
    assert Path(spark.sparkContext.getCheckpointDir().replace("file:", "")).exists()


def test_empty_tables(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
