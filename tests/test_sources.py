"""Readers and sinks on small files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import readers, sinks


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_json_files(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "a.json").write_text(json.dumps({"book": 1, "chapters": {"1": [{"verse": 1, "text": "x"}, {"verse": 2, "text": "y"}]}}))
    assert rows(readers.verses(spark, str(tmp_path))) == [(1001001, "x"), (1001002, "y")]


def test_entries(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "1.json").write_text(json.dumps({"book": 1, "chapter": 2, "entries": [{"author": "Ann", "verseStart": 5, "text": "t"}, {}]}))
    (tmp_path / "g" / "2.json").write_text("{broken")
    (tmp_path / "g" / "3.json").write_text('{"book": 1}')
    (tmp_path / "g" / "_manifest.json").write_text("{}")
    good, bad = readers.entries(spark, str(tmp_path))
    assert rows(good.select("book", "chapter", "position", "author", "verseStart", "verseEnd", "text")) == [(1, 2, 0, "Ann", 5, 0, "t"), (1, 2, 1, "", 0, 0, "")]
    assert sorted(r.reason for r in bad.collect()) == ["bad JSON", "bad shape"]
    ids = readers.occurrence_ids(good.withColumn("base", F.lit("b")), "base", "position")
    assert sorted(r.source_id for r in ids.collect()) == ["b", "b#1"]


def test_words(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "1.json").write_text(json.dumps({"book": 1, "chapter": 1, "verses": {"3": [{"w": "a", "s": "H12"}, {"w": "b", "s": "H12 "}, {"w": "c", "s": "x"}]}}))
    assert rows(readers.concordance(readers.tagged_words(spark, str(tmp_path)))) == [("H12", 1001003)]


def test_topic_votes(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "v.tsv").write_text("Topic\tRef\tVotes\nart\tGen.1.2\t3\nart\tGen.1.4-Gen.1.6\t2\nart\tNope.1.1\t1\n")
    books = spark.createDataFrame([("Gen", 1, "Genesis")], "code string, book int, name string")
    topics, failed = readers.topic_votes(spark, str(tmp_path / "v.tsv"), books)
    assert rows(topics) == [("art", "Genesis 1:2; Genesis 1:4–Genesis 1:6", [(1001002, 1001002), (1001004, 1001006)])]
    assert rows(failed) == [("art", "Nope.1.1")]


def test_usfm(spark: SparkSession, tmp_path: Path) -> None:
    text = '\\id GEN x\n\\h Genesis\n\\c 1\n\\p\n\\v 1 In \\w the|strong="H1"\\w* start\\f + note\\f*.\n\\q1 More\n\\v 2-3 Two \\v 4a four\n\\c 2\n\\s head\n\\v 1 Next\n\\v 2\n'
    (tmp_path / "g.usfm").write_text(text)
    (tmp_path / "x.usfm").write_text("\\id XXX\n\\c 1\n\\v 1 no\n")
    assert rows(readers.usfm(spark, str(tmp_path))) == [(1001001, "In the start. More"), (1001002, "Two"), (1001003, ""), (1001004, "four"), (1002001, "Next"), (1002002, "")]


def test_sinks(spark: SparkSession, tmp_path: Path) -> None:
    path = str(tmp_path / "t")
    table = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert sinks.insert_new(table((1, "a"), (1, "a"), (2, "b")), path, ["k"]) == (2, 1)
    assert sinks.insert_new(table((2, "c"), (3, "c")), path, ["k"]) == (1, 1)
    sinks.upsert(table((3, "d"), (4, "e")), path, ["k"], F.desc("v"))
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (3, "d"), (4, "e")]
    sinks.replace_table(spark.read.parquet(path).where("k > 2"), path)
    assert rows(spark.read.parquet(path)) == [(3, "d"), (4, "e")]
    groups = str(tmp_path / "g")
    sinks.replace_groups(table((1, "a"), (2, "b")), groups, "k")
    sinks.replace_groups(table((2, "c"), (2, "d")), groups, "k")
    assert rows(spark.read.parquet(groups).select("k", "v")) == [(1, "a"), (2, "c"), (2, "d")]
    sinks.sharded_json(table((1, "a"), (2, "b")), str(tmp_path / "j"), "k", 4)
    assert rows(spark.read.json(str(tmp_path / "j")).select("k", "v")) == [(1, "a"), (2, "b")]
    sinks.csv_export(table((1, "a"), (2, "b")), str(tmp_path / "c"), table((2, "x")), "k")
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "c"))) == [("1", "a")]
    with pytest.raises(ValueError, match="other"):
        sinks.copy_tables(spark, "/root/testdata/sf0.001", str(tmp_path / "copy"), ["region", "other"], frozenset({"region"}))
    sinks.copy_tables(spark, "/root/testdata/sf0.001", str(tmp_path / "copy"), ["region"], frozenset({"region"}))
    assert spark.read.parquet(str(tmp_path / "copy" / "region.parquet")).count() == 5


def test_commentary_chunks(spark: SparkSession) -> None:
    rows = [("f", 1, 1, p, a, "My Work!", t, 1, 2) for p, (a, t) in enumerate([("A", "first. second."), ("A", " "), ("A", "third"), ("B", "fourth")])]
    entries = spark.createDataFrame(rows, "file string, book int, chapter int, position int, author string, sourceTitle string, text string, verseStart long, verseEnd long")
    books = spark.createDataFrame([(1, "genesis")], "book int, slug string")
    found = readers.commentary_chunks(entries, books, lambda t: [(None, p) for p in t.split(". ")])
    assert sorted((r.source_id, r.chunk, r.text, r.verse_id, r.verse_end) for r in found.collect()) == [
        ("commentary:genesis:1:1-2:A:my-work", 0, "first", 1001001, 1001002), ("commentary:genesis:1:1-2:A:my-work", 1, "second.", 1001001, 1001002),
        ("commentary:genesis:1:1-2:A:my-work#2", 0, "third", 1001001, 1001002), ("commentary:genesis:1:1-2:B:my-work", 0, "fourth", 1001001, 1001002),
    ]
