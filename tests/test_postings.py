"""The text index against plain search of the texts, and what its plans read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import fulltext as T
from corpusloom.operators import postings as P
from corpusloom.session import table

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "The quick brown fox; the QUICK dog", "en"), (2, "quick the brown fox", "en"), (3, None, "en"), (4, "", "de"), (5, "fox brown quick the the the", "de"),
    (6, "licensing the licenses, licensed: the license", "en"), (7, "<b>the</b> quick&#39;s brown", None), (8, "the " * 5000 + "fox", "de"), (9, "Ü ñ 12", "en"),
]
QUESTIONS = ["the", "fox the", '"the quick"', '"quick brown fox" OR license', "fox -dog", "-the", "-the OR fox", '"the the"', "nothing here", "", '"brown quick the" -dog', "the OR -fox", "12"]


@pytest.fixture(scope="module")
def indexes(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory):
    texts = spark.createDataFrame(TEXTS, "id long, text string, lang string").repartition(3)
    return texts, {c: P.build(texts, str(tmp_path_factory.mktemp(c)), ("id",), F.col("text"), ("lang",), c) for c in ("simple", "english")}


@pytest.mark.parametrize("config", ["simple", "english"])
@pytest.mark.parametrize("question", QUESTIONS)
def test_same_as_search_of_texts(spark: SparkSession, indexes, question: str, config: str) -> None:
    texts, index = indexes
    node = T.parsed(question, config)
    want = T.matches(texts.where("text is not null"), question, config)
    found = P.search(index[config], spark, question)
    negative = node is not None and P.without_words(node)
    if node is None:
        assert found.rows.collect() == []
        return
    ranks = lambda r: {x.id: (round(x.a, 9), round(x.b, 9)) for x in r}
    own = ranks(found.rows.select("id", P.rank(found, node).alias("a"), P.cover_rank(found, node).alias("b")).collect()) if node.terms() else {r.id: None for r in found.rows.collect()}
    plain = ranks(want.select("id", T.rank(F.col("words"), node).alias("a"), T.cover_rank(F.col("words"), node).alias("b")).collect()) if node.terms() else {r.id: None for r in want.collect()}
    # The index also knows the document without a text.
    assert {k: v for k, v in own.items() if k != 3} == plain and (3 in own) == negative


def test_fence_columns_and_frequencies(spark: SparkSession, indexes) -> None:
    _, index = indexes
    i = index["simple"]
    assert sorted((r.id, r.lang) for r in P.search(i, spark, "the", where=F.col("lang") == "de", columns=("lang",)).rows.collect()) == [(5, "de"), (8, "de")]
    assert sorted(r.id for r in P.search(i, spark, "-the", where=F.col("lang") == "en").rows.collect()) == [3, 9]
    assert i.frequencies(spark, ["the", "fox", "cat"]) == {"the": 6, "fox": 4, "cat": 0}
    rows = {(r.term, r.id): (r.n, list(r.places)) for r in i.postings(spark, ["quick", "the"]).collect()}
    assert rows["quick", 1] == (2, [2, 6]) and rows["the", 1] == (2, [1, 5]) and rows["the", 7] == (1, [1]) and rows["the", 8][0] == 5000


def test_rare_words_cut_the_rest(spark: SparkSession, indexes, monkeypatch: pytest.MonkeyPatch) -> None:
    _, index = indexes
    with_cut = sorted(r.id for r in P.search(index["simple"], spark, "the fox").rows.collect())
    monkeypatch.setattr(P, "RARE", 0)
    assert sorted(r.id for r in P.search(index["simple"], spark, "the fox").rows.collect()) == with_cut == [1, 2, 5, 8]


@pytest.mark.parametrize("name", ["fts_question", "fts_or_rank", "fts_cover_rank", "fts_and_rank", "fts_works_page", "fts_english", "fts_fenced", "fts_commentary", "fts_phrase", "fts_simple_rank", "rrf_fuse"])
def test_searches_read_no_text(spark: SparkSession, name: str) -> None:
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*>?[^>]*)>", plan)
    assert read and not any(re.search(r"\btext:", r) for r in read)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_stored_once_and_again_when_files_change(spark: SparkSession, tmp_path) -> None:
    path = str(tmp_path / "t")
    table(spark, SF, "conversations").where("conv_id < 5").coalesce(1).write.parquet(path)
    stored = lambda: P.stored(spark.read.parquet(path), ("conv_id", "turn"), F.col("text"))
    first = stored()
    assert stored() == first
    n = P.search(first, spark, "the").rows.count()
    table(spark, SF, "conversations").where("conv_id >= 5").coalesce(1).write.mode("append").parquet(path)
    second = stored()
    assert second.path != first.path and P.search(second, spark, "the").rows.count() > n


def test_nothing_to_index(spark: SparkSession, tmp_path) -> None:
    none = spark.createDataFrame([], "id long, text string")
    index = P.build(none, str(tmp_path / "n"), ("id",), F.col("text"))
    assert P.search(index, spark, "the OR -fox").rows.collect() == []
