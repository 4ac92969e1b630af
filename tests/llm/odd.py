"""Tables of awkward documents for the operators' tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, size string, score string, label int, words string"


def odd_documents(spark: SparkSession, texts: list[tuple[int | None, str | None, str | None]], parts: int = 3) -> DataFrame:
    """Rows of (doc_id, text, lang) with further columns that are null or named as an operator's own."""
    return spark.createDataFrame([(d, t, lang, None, None, 7, "x", None, 1, "y") for d, t, lang in texts], SCHEMA).repartition(parts)
