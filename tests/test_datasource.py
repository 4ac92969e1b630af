"""The data source of JSON lines: ranges of bytes, pushed filters, bad lines, and writes that fail."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import datasource
from corpusloom.sources.datasource import LinesReader
from corpusloom.session import table

SCHEMA = "doc_id long, text string, lang string, score double, tags array<string>"


@pytest.fixture(autouse=True)
def registered(spark: SparkSession) -> None:
    datasource.register(spark)


def made(folder: Path, n: int = 400) -> list[dict]:
    rows = [{"doc_id": i, "text": "wörds 😀 " * (i % 40), "lang": ["en", "de", None][i % 3], "score": i / 4, "tags": ["a"] * (i % 3)} for i in range(n)]
    folder.mkdir()
    for k in range(3):
        text = "\n".join(json.dumps({a: b for a, b in r.items() if b is not None}, ensure_ascii=bool(k)) for r in rows[k::3])
        (folder / f"f{k}.jsonl").write_text(text + "\n" * k + ("\n \n" if k == 2 else ""), encoding="utf-8")
    (folder / "other.txt").write_text("no json")
    return rows


@pytest.mark.parametrize("split_mb", [64, 0.0005, 0.00002])
def test_every_line_once_whatever_the_ranges(spark: SparkSession, tmp_path: Path, split_mb: float) -> None:
    rows = made(tmp_path / "in", 400 if split_mb > 0.0001 else 25)
    df = spark.read.format("corpus_lines").schema(SCHEMA).option("split_mb", split_mb).load(str(tmp_path / "in"))
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    assert got == [{**r, "lang": r["lang"]} for r in rows]
    assert df.rdd.getNumPartitions() == 3 if split_mb == 64 else df.rdd.getNumPartitions() > 3


def test_filters_reach_the_reader(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = made(tmp_path / "in")
    df = spark.read.format("corpus_lines").schema(SCHEMA).load(str(tmp_path / "in"))
    found = df.where("lang = 'de' and doc_id > 100 and score <= 80 and text like 'w%' and size(tags) > 0")
    assert sorted(r.doc_id for r in found.collect()) == [r["doc_id"] for r in rows if r["lang"] == "de" and r["doc_id"] > 100 and r["score"] <= 80 and r["text"] and r["tags"]]
    assert df.where("lang is null").count() == sum(r["lang"] is None for r in rows) and df.where(F.col("lang").isin("en", "fr")).count() == sum(r["lang"] == "en" for r in rows)
    reader = LinesReader(str(tmp_path / "in"), df.schema, 1 << 20)
    left = list(reader.pushFilters([datasource.EqualTo(("lang",), "de"), datasource.EqualTo(("tags", "x"), "a"), datasource.GreaterThan(("doc_id",), 100)]))
    assert len(left) == 1 and sum(len(b) for p in reader.partitions() for b in reader.read(p)) == sum(r["lang"] == "de" and r["doc_id"] > 100 for r in rows)
    plan = df.where("lang = 'de'")._jdf.queryExecution().executedPlan().toString()
    assert "lang" in plan


def test_bad_lines(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "x.jsonl").write_text('{"doc_id": 1}\nnot json\n[1, 2]\n{"doc_id": 2, "text": "b"}\n')
    read = lambda schema: spark.read.format("corpus_lines").schema(schema).load(str(tmp_path / "x.jsonl"))
    assert sorted((tuple(r) for r in read("doc_id long, text string, _bad string").collect()), key=repr) == [(1, None, None), (2, "b", None), (None, None, "[1, 2]"), (None, None, "not json")]
    with pytest.raises(Exception, match="not json"):
        read("doc_id long").collect()


def test_append_overwrite_and_round_trip(spark: SparkSession, tmp_path: Path) -> None:
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source")
    out = str(tmp_path / "out")
    docs.repartition(4).write.format("corpus_lines").mode("append").save(out)
    back = lambda: spark.read.format("corpus_lines").load(out)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back()) == rows(docs)
    docs.where("doc_id < 5").write.format("corpus_lines").mode("append").save(out)
    assert back().count() == docs.count() + docs.where("doc_id < 5").count()
    docs.where("doc_id >= 190").write.format("corpus_lines").mode("overwrite").save(out)
    assert rows(back()) == rows(docs.where("doc_id >= 190"))
    assert all(p.suffix == ".jsonl" for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))


def test_a_failed_write_leaves_nothing(spark: SparkSession, tmp_path: Path) -> None:
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source")
    out = tmp_path / "out"
    docs.where("doc_id < 10").write.format("corpus_lines").mode("append").save(str(out))
    before = sorted(p.name for p in out.iterdir())
    broken = docs.repartition(4).withColumn("source", F.when(F.col("doc_id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("source")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            broken.write.format("corpus_lines").mode(mode).save(str(out))
        assert sorted(p.name for p in out.iterdir()) == before
