"""Chunkers, normalisation and answer checks on small cases."""

from __future__ import annotations

import json
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from corpusloom.functions.normalize import decoded, normal, snapped
from corpusloom.operators import chunking, contract

TEXT = st.text(alphabet="aB1. \n!", max_size=300)


@given(TEXT)
def test_pieces_fit_and_keep_everything(text: str) -> None:
    squeezed = re.sub(r"\s", "", text)
    for cutter in (chunking.paragraphs, chunking.sentences):
        pieces = [p for _, p in cutter(text, 40)]
        assert all(len(p) <= 40 for p in pieces)
        assert re.sub(r"\s", "", "".join(pieces)) == squeezed
    assert all(len(p) <= 40 for _, p in chunking.prose(text, 40))


def test_prose_headings() -> None:
    assert list(chunking.prose("THE FIRST PART\n\nOne. Two.\n\nThree.\n\nII. Second head\n\nFour.", 100)) == [("THE FIRST PART", "One. Two.\n\nThree."), ("II. Second head", "Four.")]
    assert list(chunking.prose("One. Two. Three.", 9)) == [(None, "One. Two."), (None, "Three.")]
    assert list(chunking.prose("", 9)) == []


def test_narrative_counts() -> None:
    assert list(chunking.narrative("short")) == [(None, "short")]
    assert [h for h, _ in chunking.narrative("A sentence. " * 300)][:1] == ["(1/4)"]


def test_normal_forms() -> None:
    assert decoded("&#8217;&AMP;&nope;&#x41;&shy;&nbsp;") == "’&&nope;A "
    assert normal("“Fish”—and CHIPS&hellip;") == "fish and chips"
    body = "In the beginning there was a long and winding road that led to nowhere at all."
    assert snapped("beginning there was", body) == "beginning there was"
    assert snapped("In the beginning there was a long and winding road, said they", body) == "In the beginning there was a long and winding road,"
    assert snapped("In the end", body) is None
    assert snapped("...", body) is None


def test_contract(spark: SparkSession) -> None:
    by = {"author": "Ann", "work": "Book", "tradition": "T", "origin": "corpus"}
    voice = {"type": "voice", "section_id": 1, "attribution": by, "quote": "a road", "anchors": [{"start": 1001001, "end": 1001003}]}

    def answer(*blocks: dict) -> str:
        return json.dumps({"contract_version": "1.1", "teacher": "t", "blocks": list(blocks)})

    cases = {
        0: (answer(voice), set()),
        1: ("{not json", {"schema"}),
        2: (answer(voice | {"section_id": 9}), {"section_resolves"}),
        3: (answer(voice | {"quote": "no such", "anchors": [{"start": 66001001, "end": 66001002}]}), {"quote_verbatim", "anchor_valid"}),
        4: (answer(voice, {"type": "passages", "items": [{"start": 1001002, "end": 1001004, "translation": "web"}, {"start": 1001003, "end": 1001001, "translation": "old"}]}), {"passages_grounded", "passage_order", "translation_licensed"}),
        5: (answer(voice, {"type": "framing", "text": "You must go; you MUST."}), {"screen:I3"}),
        6: (answer(voice | {"attribution": by | {"origin": "user_library"}}), {"section_resolves", "diversity_voices"}),
        7: (answer(voice | {"attribution": by | {"author": "Bo", "work": "x", "tradition": "u"}}), {"attribution_author", "attribution_work", "attribution_tradition"}),
        8: (answer(voice, {"type": "reading", "items": [{"source_id": 1, "title": "x", "author": "Bo"}, {"source_id": 2, "title": "x", "author": "Bo"}]}), {"reading_attribution", "reading_resolves"}),
        9: (answer(voice | {"anchors": [{"start": 1001003, "end": 1001001}, {"start": 1002001, "end": 1002001}]}), {"anchor_order", "anchor_offbase"}),
        10: (answer({"type": "song"}), {"schema"}),
        11: (answer(voice, {"type": "passages", "items": [{"start": 1001002, "end": 1001003, "translation": "web"}]}), {"passage_exists"}),
    }
    answers = spark.createDataFrame([(k, v[0], 1, ["T"]) for k, v in cases.items()], "response_id long, body string, n_sections int, traditions array<string>")
    sections = spark.createDataFrame([(1, "corpus", "It is a road.", None, "Ann", "Book", "T", 1001001, 1001009)], "section_id long, origin string, body string, heading string, author string, title string, tradition string, verse_start long, verse_end long")
    sources = spark.createDataFrame([(1, "Ann")], "source_id long, author string")
    translations = spark.createDataFrame([("web", True), ("old", False)], "slug string, usable boolean")
    missing = spark.createDataFrame([("web", 1001003)], "translation string, verse_id long")
    found: dict[int, set[str]] = {k: set() for k in cases}
    rows = contract.violations(answers, sections, sources, translations, missing, {1: 50}).collect()
    for r in rows:
        found[r.response_id].add(r.check)
    assert found == {k: v[1] for k, v in cases.items()}
    assert sum(r.response_id == 5 for r in rows) == 1


def test_chunked_rows(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.chunked(docs, "doc_id", chunking.prose).collect()] == [(1, 0, None, "One. Two.")]


def test_answers_are_set_right(spark: SparkSession) -> None:
    body = {"contract_version": "1.0", "teacher": "t", "blocks": [
        {"type": "voice", "section_id": " 2", "attribution": {"author": "typed", "origin": "user_library"}, "quote": "In the beginning was the word, and the word was with others who drift", "anchors": [{"start": "43001001", "end": 43001002}]},
        {"type": "voice", "section_id": "9", "attribution": {"author": "typed", "work": "w"}, "quote": "kept"},
        {"type": "reading", "items": [{"source_id": "7", "title": "a", "author": "b"}, {"source_id": "seven", "title": "a", "author": "b"}]},
    ]}
    answers = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "response_id int, body string")
    text = "In the beginning was the word, and the word was with God, and so on for long."
    sections = spark.createDataFrame([(1, 1, "x", "x", "x", None, None, "x"), (1, 2, "John", "Gospel", "none", "john", None, text)], "response_id int, place int, author string, work string, tradition string, slug string, origin string, body string")
    found = {r.response_id: r.body for r in contract.normalized_answers(answers, sections).collect()}
    assert (found[2], found[3]) == ("no json", None)
    first, second, reading = json.loads(found[1])["blocks"]
    assert first["attribution"] == {"author": "John", "work": "Gospel", "slug": "john", "tradition": "none", "origin": "user_library"}
    assert (first["section_id"], first["anchors"]) == (2, [{"start": 43001001, "end": 43001002}])
    assert first["quote"] == "In the beginning was the word, and the word was with"
    assert (second["section_id"], second["attribution"]["author"], second["quote"]) == (9, "typed", "kept")
    assert [i.get("source_id") for i in reading["items"]] == [7, None]
