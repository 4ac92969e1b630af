"""The queries of these operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import collocations, fill_middle, jaccard_join, licenses, media, ngram_lm, packing, pieces, pii, quality, secrets, toxicity, vector_join
from corpusloom.llm.shared import fold
from corpusloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    found = toxicity.score(documents, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.learn(documents))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(table(spark, sf_dir, "documents"), ngram_lm.held_out_by_crc(5, 1))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    key = fold(F.col("doc_id"), 4)
    scored = quality.fit_and_score(documents, table(spark, sf_dir, "labels"), fit_rows=key.isin(0, 1), calibrate_rows=key == 3)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licenses.by_document(documents, licenses.scan(documents, licenses.fit(documents)))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = collocations.SQL


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.scan(documents, pii.fit(documents))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(table(spark, sf_dir, "documents"), digests=True)


ORACLES["op13_fill_middle"] = fill_middle.SQL
