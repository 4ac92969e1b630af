"""From raw documents to packed token sequences, in stages that are each written and read again.

Toxic and low-quality documents go, one document of each group of near copies
stays, secrets are masked, and what is left is packed. A stage works on what its
predecessor kept and learns from the labels of those documents alone. ORACLE_SQL
is None, as SQL expresses none of the trained stages; tests compare the stages with
plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, packing, quality, secrets, toxicity
from corpusloom.llm.shared import collected, fold, written
from corpusloom.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.kept(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    key = fold(F.col("doc_id"), 4)
    stats = written(quality.with_statistics(docs), "quality-stats")
    return quality.kept(docs, quality.learn(stats, table(spark, sf_dir, "labels"), fit_rows=key.isin(0, 1), calibrate_rows=key == 3))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return secrets.redact(docs, secrets.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
