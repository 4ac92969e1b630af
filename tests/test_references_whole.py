"""References: names are looked up, not walked through, and texts made from one file's rows are read on all cores."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from corpusloom import catalog
from corpusloom.functions import references

SF = "/root/testdata/sf0.001"


class Closed(dict):
    def items(self) -> None:
        raise AssertionError("all names are walked through")


def test_names_are_looked_up(monkeypatch: pytest.MonkeyPatch) -> None:
    names = dict(references.NAMES)
    begins = lambda raw: sorted({b for n, b in names.items() if n.startswith(raw)} or {b for n, b in names.items() if n[:1] in "123" and n[1] == " " and n[2:].startswith(raw)}, key=lambda b: b.number)
    monkeypatch.setattr(references, "NAMES", Closed(names))
    for raw in ("ju", "j", "sam", "corinth", "chapter", "1 c", "lamentati", "xyz", "the"):
        assert references.books_called(raw) == ([names[raw]] if raw in names else begins(raw))
    assert references.books_called("") == []


@pytest.mark.parametrize("name", ["reference_scan", "topic_lists", "question_intents", "stated_periods"])
def test_rows_of_one_file_are_dealt_out(spark: SparkSession, name: str) -> None:
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 8
