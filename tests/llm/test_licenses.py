"""Licence scans on planted notices, wrapped or not, and on ordinary and odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

pytest.importorskip("corpusloom.llm")

from corpusloom.llm import licenses  # noqa: E402

PLANTED = {
    1: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    2: ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "mit"),
    3: ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "gpl-3.0"),
    4: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met", "bsd"),
    5: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
}


@pytest.fixture(scope="module")
def documents(spark: SparkSession) -> DataFrame:
    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "ter", "san", "vo", "rel", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    line = lambda: " ".join(word() for _ in range(12)) + "."
    plain = lambda n: "\n".join(line() for _ in range(n))
    rows = [(d, f"{plain(3)}\n{text}\n{plain(2)}", "s", i) for i, (d, (text, _)) in enumerate(PLANTED.items())]
    rows += [(d, plain(4), "s", d) for d in range(10, 60)]
    rows += [(60, None, "s", 0), (61, "", "s", 0), (62, "\n\n", "s", 0), (63, " ".join(word() for _ in range(60_000)), "s", 0), (9_000_000_000, plain(2), "s", 0)]
    rows += [rows[0], (None, PLANTED[1][0], "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, family string, lines int").repartition(4)


def test_planted_notices(documents: DataFrame) -> None:
    found = licenses.by_document(documents, licenses.scan(documents, licenses.fit(documents))).collect()
    own = {r.doc_id: r for r in found}
    assert len(found) == len(own)
    assert {d: own[d].families for d in PLANTED} == {d: family for d, (_, family) in PLANTED.items()}
    assert all(own[d].n_licenses >= 1 for d in PLANTED)
    assert [d for d, r in own.items() if d is not None and d >= 10 and r.n_licenses] == []


def test_wrapped_notices_are_one(documents: DataFrame) -> None:
    found = [r for r in licenses.scan(documents, licenses.fit(documents)).where("confirmed").collect() if r.doc_id in PLANTED]
    by_doc = {d: [r for r in found if r.doc_id == d] for d in PLANTED}
    assert all(r.containment >= 0.6 for r in found)
    assert [(r.paragraph, r.lines) for r in by_doc[1]] == [(3, 1)]
    assert len(by_doc[3]) == 1 and by_doc[3][0].paragraph == 3


def test_scores_are_those_of_the_model(documents: DataFrame) -> None:
    model = licenses.fit(documents)
    for r in licenses.scan(documents, model).where("lines = 1").collect():
        text = next(x.text for x in documents.where("doc_id <=> %s" % ("null" if r.doc_id is None else r.doc_id)).collect())
        z = model.logits(licenses.plain_words(text.split("\n")[r.paragraph]))
        assert licenses.FAMILIES[int(z.argmax())] == r.family


def test_nothing(spark: SparkSession, documents: DataFrame) -> None:
    empty = documents.limit(0)
    assert licenses.by_document(empty, licenses.scan(empty, licenses.fit(empty))).collect() == []
