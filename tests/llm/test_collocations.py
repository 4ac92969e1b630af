"""Mined phrases against plain counting, with samples that propose much, little and nothing."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from odd import odd_documents
from oracle import duck_rows, spark_rows
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import collocations, registry
from corpusloom.llm.collocations import Bloom, Config

UPPER = {c: c + 32 for c in range(65, 91)}


def plainly(rows: list[tuple], config: Config) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, config.longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= config.least}
    gone = set()
    for (lang, p), longer in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * longer >= config.redundant * f[lang, p[i : i + size]]:
                    gone.add((lang, p[i : i + size]))
    out = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[: config.top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(ranked)


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "The", "of", "ünder", "語", "a-b", "x y", *"abcdefghij"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\r\n", "?", ";"]
    return [(i, "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for i in range(n)]


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("longest", "sample_mb"), [(3, 0.0), (3, 0.002), (3, 100.0), (5, 0.0), (2, 0.002)])
def test_against_plain_counting(spark: SparkSession, longest: int, sample_mb: float) -> None:
    rows = texts(longest, 150)
    config = Config(least=4, longest=longest, sample_mb=sample_mb, top=300)
    docs = odd_documents(spark, rows)
    assert rows_of(collocations.collocations(docs, config)) == plainly(rows, config)


def test_passes_end_when_the_border_holds(spark: SparkSession, tmp_path) -> None:
    rows = texts(9, 200)
    path = str(tmp_path / "docs")
    odd_documents(spark, rows).write.parquet(path)
    docs = spark.read.parquet(path)
    few = collocations.mine(docs, Config(least=4, sample_mb=0.0))
    all_of_it = collocations.mine(docs, Config(least=4, sample_mb=100.0))
    assert few.failures[0] > 0 and few.failures[-1] == 0 and few.passes <= 3
    assert all_of_it.passes == 1 and all_of_it.failures == [0]
    assert rows_of(few.counts) == rows_of(all_of_it.counts)


def test_small_filters_change_nothing(spark: SparkSession) -> None:
    rows = texts(4, 150)
    config = Config(least=4, sample_mb=0.0, top=300)
    assert rows_of(collocations.collocations(odd_documents(spark, rows), replace(config, filter_bits=64))) == plainly(rows, config)


def test_filter_holds_what_it_was_made_of() -> None:
    h = np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(256, np.uint64)
    for at in Bloom.places(h[:300], 256 * 64):
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    found = Bloom(bits).holds(h)
    assert found[:300].all() and found[300:].mean() < 0.1


def test_odd_rows(spark: SparkSession) -> None:
    repeated = [(5, "one two three. " * 12, "en")] * 4
    rows = [(1, None, "en"), (2, "", "en"), (None, "One Two three " * 30, None), (3, "\n\n..", "fr"), *repeated, (7, "long " * 200_000, "xx")]
    config = Config()
    assert rows_of(collocations.collocations(odd_documents(spark, rows), config)) == plainly(rows, config)
    assert not collocations.collocations(odd_documents(spark, rows).limit(0), config).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_of_sql(spark: SparkSession, name: str) -> None:
    sf = "/root/testdata/sf0.001"
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duck_rows(registry.ORACLES[name], sf)
