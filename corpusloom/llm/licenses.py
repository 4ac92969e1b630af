"""License scans: paragraphs classified by licence family with DataFrame functions.

Paragraphs are lines, and what neighbouring lines that each hold a content word (below)
make together, as notices are often wrapped: such a run counts where it is a confirmed licence and
none of its lines is by itself. Features are word 1- to 3-grams (A-Z in lower case; words
are runs of a-z, 0-9 and dots between them) that occur in the templates and hold
a content word, that is, one no ordinary paragraph of the training sample has. A
multinomial logistic regression over these sparse features and the share of a
paragraph's words that are content words is fitted on a bounded sample: the
templates, whole and with words left out, and ordinary paragraphs as class
"unknown"; texts of which a template is a good part are not ordinary. The unknown class's offset is calibrated on ordinary paragraphs that
were held back, so that at most a share of `mistaken` of them looks like a licence. A prediction counts as confirmed when enough of the n-grams of
one of the family's templates are found in the paragraph.

Fitting happens on a few thousand feature rows of that sample; scanning all
documents is split, explode, a join with the broadcast weights (a few hundred
rows, bounded by the templates) and sums, without Python on the executors.
A paragraph without any feature is never more than unknown, so skipping it
changes nothing.

Null and empty texts have no paragraphs. Rows that repeat a doc_id are reported
once, over all their texts. Other columns of the input play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Notices by family, as licences ask for them to be written.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the License, or (at your option) any later version of the GNU General Public License",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright holder reserves all rights. No part of this work may be reproduced without prior written permission.",
    ],
}
FAMILIES = [*TEMPLATES, "unknown"]
NOT_WORD = r"[^a-z0-9.]+|\.(?![a-z0-9])|(?<![a-z0-9])\."


@dataclass(frozen=True)
class Config:
    sample_documents: int = 300  # ordinary documents whose paragraphs may be sampled
    sample_paragraphs: int = 3000
    sample_words: int = 400  # ordinary paragraphs with more are not sampled
    mistaken: float = 0.001  # share of the ordinary paragraphs held back
    left_out: int = 8  # variants of each template with words left out
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    confirm: float = 0.6  # of a template's n-grams
    seed: int = 5


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), NOT_WORD), lambda w: w != "")


def plain_words(paragraph: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, paragraph.translate({c: c + 32 for c in range(65, 91)})) if w]


def plain_ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def ngrams(words: Column) -> Column:
    """Different 1- to 3-grams, words joined by blanks."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(words, of(2), of(3)))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, text, paragraph, words) of every line that holds a word; text is a hash that tells texts of the same doc_id apart."""
    lines = documents.select("doc_id", F.xxhash64("text").alias("text"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "text", "paragraph", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)


UNIT = ["doc_id", "text", "run", "paragraph", "lines"]


def with_runs(lines: DataFrame) -> DataFrame:
    """(UNIT, words) of lines, and of each run of two or more neighbouring ones as one, from its first."""
    order = Window.partitionBy("doc_id", "text").orderBy("paragraph")
    single = lines.dropDuplicates(["doc_id", "text", "paragraph"]).withColumn("run", F.col("paragraph") - F.row_number().over(order)).withColumn("lines", F.lit(1))
    runs = single.groupBy("doc_id", "text", "run").agg(F.count("*").cast("int").alias("lines"), F.array_sort(F.collect_list(F.struct("paragraph", "words"))).alias("w")).where("lines > 1")
    joined = runs.select("doc_id", "text", "run", F.col("w")[0]["paragraph"].alias("paragraph"), "lines", F.flatten(F.col("w.words")).alias("words"))
    return single.select(*UNIT, "words").unionByName(joined)


@dataclass
class Model:
    content: list[str]
    features: list[str]
    weights: np.ndarray  # (feature, family)
    share: np.ndarray  # weight of the share of content words, by family
    bias: np.ndarray

    def logits(self, words: list[str]) -> np.ndarray:
        """Of one paragraph, as scan() computes them."""
        known, place = set(self.content), {f: i for i, f in enumerate(self.features)}
        own = [place[g] for g in plain_ngrams(words) if g in place]
        return self.bias + self.share * (sum(w in known for w in words) / max(len(words), 1)) + self.weights[own].sum(0)


def train(ordinary: list[list[str]], config: Config = Config()) -> Model:
    """Fit on the templates and on the words of ordinary paragraphs."""
    rng = np.random.default_rng(config.seed)
    common = {w for words in ordinary for w in words}
    rows, labels = [], []
    for label, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = plain_words(template)
            rows.append(words)
            labels.append(label)
            for _ in range(config.left_out):
                kept = [w for w in words if rng.random() > 0.15]
                if len(kept) >= 2:
                    rows.append(kept)
                    labels.append(label)
    every = {w for r in rows for w in r}
    content = sorted(every - common)
    known = set(content)
    features = sorted({g for r in rows for g in plain_ngrams(r) if known.intersection(g.split(" "))})
    place = {f: i for i, f in enumerate(features)}
    half = len(ordinary) // 2
    fit_rows = rows + ordinary[:half]
    y = np.array(labels + [len(FAMILIES) - 1] * half)

    def matrix(paragraphs_: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(paragraphs_), len(features) + 2))
        for i, words in enumerate(paragraphs_):
            x[i, [place[g] for g in plain_ngrams(words) if g in place]] = 1
            x[i, -2] = sum(w in known for w in words) / max(len(words), 1)
            x[i, -1] = 1
        return x

    # Equal rows, such as all without a feature, are fitted as one. The root of how many they were is their weight, so that ordinary text doesn't outweigh the families.
    x, target = matrix(fit_rows), np.eye(len(FAMILIES))[y]
    x, which = np.unique(np.column_stack([x, target]), axis=0, return_inverse=True)
    count = np.bincount(which.ravel()).astype(float)
    x, target = x[:, : len(features) + 2], x[:, len(features) + 2 :]
    weight = np.sqrt(count)[:, None] / len(x)
    theta, m, v = (np.zeros((x.shape[1], len(FAMILIES))) for _ in range(3))
    for step in range(1, config.steps + 1):
        z = x @ theta
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (weight * (p - target)) + config.decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= config.rate / 5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(content, features, theta[:-2], theta[-2], theta[-1].copy())
    # Calibrated on the paragraphs held back, and on one without features, which must stay unknown; half a nat to spare.
    lead = np.array([z[:-1].max() - z[-1] for z in map(model.logits, ordinary[half:])])
    nothing = float(model.bias[:-1].max() - model.bias[-1])
    model.bias[-1] += max(0.0, nothing + 0.5, float(np.quantile(lead, 1 - config.mistaken)) + 0.5 if len(lead) else 0.0)
    return model


def fit(documents: DataFrame, config: Config = Config()) -> Model:
    """Learn from the templates and at most config.sample_paragraphs whole paragraphs that hold less than half of each template's 3-grams, and fewer of theirs than others."""
    few = documents.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample_documents)
    sample = paragraphs(documents.join(F.broadcast(few), "doc_id", "left_semi"))
    triples = [[" ".join(w[i : i + 3]) for i in range(len(w) - 2)] for family in TEMPLATES.values() for t in family if len(w := plain_words(t)) > 2]
    own = ngrams(F.col("words"))
    like = [F.size(F.array_intersect(own, F.array(*map(F.lit, t)))) * 2 >= len(set(t)) for t in triples]
    alike = like[0]
    for x in like[1:]:
        alike = alike | x
    # So is a line of a wrapped notice, most of whose own 3-grams are a template's.
    shared = F.size(F.array_intersect(own, F.array(*map(F.lit, sorted({t for ts in triples for t in ts})))))
    alike = alike | ((shared > 0) & (shared * 2 >= F.size("words") - 2))
    few_words = sample.where(F.size("words") <= config.sample_words).withColumn("h", F.xxhash64("doc_id", "paragraph")).orderBy("h").limit(2 * config.sample_paragraphs)
    ordinary = few_words.where(~alike).select("words", "h")
    return train([list(r.words) for r in ordinary.orderBy("h").limit(config.sample_paragraphs).collect()], config)


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table written into the plan."""
    def lit(x: object) -> str:
        if isinstance(x, (list, np.ndarray)):
            return "array(" + ", ".join(map(lit, x)) + ")"
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{float(x)!r}D" if isinstance(x, float) else str(x)

    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} as t({names})")


def scan(documents: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """(doc_id, paragraph, lines, family, probability, containment, confirmed) of each paragraph classified as a licence; a run has its first line's number."""
    spark = documents.sparkSession
    if not model.features:
        return documents.limit(0).select(F.col("doc_id").cast("long"), F.lit(0).alias("paragraph"), F.lit(0).alias("lines"), F.lit("").alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("containment"), F.lit(False).alias("confirmed"))
    content = F.array(*map(F.lit, model.content))
    # Documents, then paragraphs, without any content word have no feature.
    some = documents.where(F.arrays_overlap(words_of(F.col("text")), content))
    units = with_runs(paragraphs(some).where(F.arrays_overlap("words", content)))
    grams = units.select(
        *UNIT, F.size("words").alias("size"),
        F.size(F.filter("words", lambda w: F.array_contains(content, w))).alias("hits"), F.explode(ngrams(F.col("words"))).alias("gram"),
    )
    templates = [(f"{family}:{i}", plain_ngrams(plain_words(t))) for family in TEMPLATES for i, t in enumerate(TEMPLATES[family])]
    weighed = values(spark, [(f, [float(x) for x in w], [float(f in g) for _, g in templates]) for f, w in zip(model.features, model.weights, strict=True)], "gram, weight, held")
    families, of = range(len(FAMILIES)), {f: [i for i, (t, _) in enumerate(templates) if t.rsplit(":", 1)[0] == f] for f in TEMPLATES}
    sums = grams.join(F.broadcast(weighed), "gram").groupBy(*UNIT, "size", "hits").agg(
        *[F.sum(F.col("weight")[k]).alias(f"w{k}") for k in families], *[F.sum(F.col("held")[k]).alias(f"t{k}") for k in range(len(templates))]
    )
    logit = [F.col(f"w{k}") + F.lit(float(model.bias[k])) + F.lit(float(model.share[k])) * F.col("hits") / F.col("size") for k in families]
    scored = sums.select(*UNIT, F.array(*logit).alias("z"), *[f"t{k}" for k in range(len(templates))])
    top = F.array_max("z")
    place = F.array_position("z", top).cast("int")
    features = set(model.features)
    share = [F.greatest(*[F.col(f"t{i}") / max(1, len(templates[i][1] & features)) for i in of[f]], F.lit(0.0)) for f in TEMPLATES] + [F.lit(0.0)]
    found = (
        scored.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), place)).where(F.col("family") != "unknown")
        .select(
            *UNIT, "family",
            (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"),
            F.element_at(F.array(*share), place).alias("containment"),
        )
        .withColumn("confirmed", F.col("containment") >= config.confirm)
    )
    of_run = Window.partitionBy("doc_id", "text", "run")
    alone, run = (F.col("lines") == 1) & F.col("confirmed"), (F.col("lines") > 1) & F.col("confirmed")
    marked = found.withColumn("_alone", F.bool_or(alone).over(of_run)).withColumn("_run", F.bool_or(run).over(of_run))
    kept = marked.where(F.when(F.col("lines") > 1, F.col("confirmed") & ~F.col("_alone")).otherwise(F.col("_alone") | ~F.col("_run")))
    return kept.select("doc_id", "paragraph", "lines", "family", "probability", "containment", "confirmed")


def by_document(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Every doc_id with its confirmed licence paragraphs: how many, which families, the least probability; and the unconfirmed ones' number."""
    own = found.groupBy("doc_id").agg(
        F.count_if("confirmed").alias("n_licenses"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.min(F.when(F.col("confirmed"), F.col("probability"))).alias("least_probability"),
    )
    every = documents.select("doc_id").distinct()
    return every.join(own, "doc_id", "left").select("doc_id", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"), F.coalesce("families", F.lit("")).alias("families"), "least_probability")
