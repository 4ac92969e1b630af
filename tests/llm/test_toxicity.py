"""Toxicity learns from its whole sample, not from a part of it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")

from corpusloom.llm import toxicity  # noqa: E402
from corpusloom.llm.words import PUNCTUATION, Words  # noqa: E402


def test_rare_word_late_in_the_sample(spark: SparkSession) -> None:
    """A word that only rows after the first 4000 of 6000 sample rows hold gets an embedding, and a text of it alone is toxic."""
    order = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[4000:4400])
    rows = [(i, f"rareword item{i % 50}" if i in late else f"item{i % 50} plain text", int(i in late)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    word = toxicity.features(Words([b"rareword"], PUNCTUATION), toxicity.Config().beginnings)[0, 0]
    assert np.isin(word, model.known)
    scored = toxicity.score(spark.createDataFrame([(1, "rareword item3"), (2, "item3 plain text")], "doc_id long, text string"), model)
    assert {r.doc_id: r.predicted for r in scored.collect()} == {1: 1, 2: 0}
