"""Trained models against plain versions of what they compute: the network's forward pass, ridge and isotonic fits, best segmentations."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import odd_documents
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import pieces, quality, toxicity
from corpusloom.llm.words import PUNCTUATION, Words


def made(seed: int, n: int) -> tuple[list[bytes], np.ndarray]:
    """Texts of which some hold a pair of words that makes them toxic."""
    rng = random.Random(seed)
    words = ["the", "of", "house", "garden", "walking", "sunlight", "und", "der", "ümläute", "x1"]
    texts, y = [], []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        bad = rng.random() < 0.4
        if bad:
            own[rng.randint(0, len(own)) :] = ["awful", "insultings", *own[-3:]]
        texts.append(" ".join(own).encode())
        y.append(int(bad))
    return texts, np.array(y)


def plain_logit(model: toxicity.Model, text: bytes, config: toxicity.Config) -> float:
    words = Words([text], PUNCTUATION)
    hashed = toxicity.features(words, config.beginnings)
    spots = toxicity.buckets_of(hashed, model.known, config.buckets).tolist()
    pooled = []
    for width in config.widths:
        table = model.tables[width]
        # Every window of the text with zeros on both sides; one of zeros alone at least.
        padded = [[]] * (width - 1) + spots + [[]] * (width - 1)
        values = [np.zeros(config.filters)]
        for begin in range(len(padded) - width + 1):
            values.append(sum((table[k][b].astype(float) for k in range(width) for b in padded[begin + k] if b), np.zeros(config.filters)))
        pooled.append(np.maximum(np.max(values, axis=0) + model.bias[width], 0))
    return float(np.concatenate(pooled) @ model.out + model.out_bias)


def test_network_against_a_plain_pass() -> None:
    config = toxicity.Config(least_docs=2, epochs=6)
    texts, y = made(1, 600)
    model = toxicity.train(texts, y, config)
    fresh, truth = made(2, 80)
    fresh += [b"", b"awful", b"... !!", b"unknown words only", b"insultings awful", ("the of " * 60_000).encode() + b"awful insultings"]
    words = Words(fresh, PUNCTUATION)
    got = toxicity.raw_logits(model, words, words.hashes(), len(fresh), config)
    assert np.allclose(got[:-1], [plain_logit(model, t, config) for t in fresh[:-1]], atol=1e-4)
    # A text's score does not depend on what it is scored with, nor on how many windows are in memory at once.
    alone = [toxicity.scores(model, [t], config)[0] for t in fresh]
    assert np.allclose(toxicity.scores(model, fresh, config), alone, atol=1e-6)
    assert ((np.array(alone[:80]) >= toxicity.THRESHOLD) == truth.astype(bool)).mean() > 0.95 and alone[-1] > 0.5


def test_toxicity_of_odd_rows(spark: SparkSession) -> None:
    texts, y = made(3, 200)
    rows = [(i, t.decode(), "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", None), (None, "awful insultings", "en"), (902, "awful insultings", "de"), (902, "awful insultings", "de"), (903, "the " * 200_000, "en")]
    docs = odd_documents(spark, rows)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(5, 1 - int(y[5])), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.score(docs, model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and score[900] == score[901] and score[None] == score[902] and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    # Without labels, or with one kind alone, all score the same.
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.kept(docs.limit(0), model).collect() == []
    assert toxicity.kept(docs, model).columns == docs.columns


@given(st.lists(st.tuples(st.floats(0.1, 5), st.floats(0, 1)), min_size=1, max_size=25))
def test_isotonic_against_its_min_max_form(rows: list[tuple[float, float]]) -> None:
    w, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mean = lambda a, b: (w[a : b + 1] * y[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, len(w))) for a in range(i + 1)) for i in range(len(w))]
    got = quality.isotonic(w, w * y)
    assert np.allclose(got, want) and (np.diff(got) >= -1e-12).all()


def test_ridge_and_calibration_against_direct_solution(spark: SparkSession) -> None:
    config = quality.Config(features=24, bins=64)
    rng = np.random.default_rng(4)
    k = len(quality.STATISTICS)
    stats = rng.normal(size=(500, k))
    label = (stats[:, 0] + 0.5 * stats[:, 1] ** 2 + 0.3 * rng.normal(size=500) > 0.4).astype(float)
    use = ["calibrate" if i % 3 == 0 else "fit" for i in range(500)]
    rows = spark.createDataFrame([(s.tolist(), float(y), u) for s, y, u in zip(stats, label, use, strict=True)], "stats array<double>, label double, use string").repartition(5)
    model = quality.fit(rows, config)
    own = np.array([u == "fit" for u in use])
    assert np.allclose(model.mean, stats[own].mean(0)) and np.allclose(model.scale, stats[own].std(0))
    phi = model.lift(stats[own], config)
    penalty = config.ridge * own.sum() * np.eye(phi.shape[1])
    penalty[0, 0] = 1e-9
    assert np.allclose(model.beta, np.linalg.solve(phi.T @ phi + penalty, phi.T @ label[own]), atol=1e-6)
    # Random features: their products approach the Gaussian kernel.
    wide = quality.Config(features=6000)
    z = model.mean + model.scale * rng.normal(0, 0.4, (30, k))
    many = quality.Model(model.mean, model.scale, np.random.default_rng(1).normal(0, 1 / wide.bandwidth, (k, 6000)), np.random.default_rng(2).uniform(0, 2 * np.pi, 6000))
    near = many.lift(z, wide)[:, 1:]
    d = ((z[:, None] - z[None]) / model.scale) ** 2
    assert np.abs(near @ near.T - np.exp(-d.sum(2) / (2 * wide.bandwidth**2))).max() < 0.08
    b = quality.bin_of(model.ridge_score(stats[~own], config), config)
    weight, total = np.bincount(b, minlength=64).astype(float), np.bincount(b, label[~own], 64)
    assert np.allclose(model.levels, quality.isotonic(weight + 0.5 / 64, total + 0.5 / 64 * label[~own].mean()))
    assert ((model.probability(stats, config) >= 0.5) == label.astype(bool)).mean() > 0.65


def plain_best(codec: pieces.Codec, table: dict[str, float], text: str) -> float:
    """The best total of any segmentation into pieces and, at codec.least each, single characters."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = max([best[end - 1] + codec.least, *(best[b] + table[text[b:end]] for b in range(end) if text[b:end] in table)])
    return best[-1]


@settings(max_examples=400)
@given(st.dictionaries(st.text(alphabet="ab▁é", min_size=1, max_size=4), st.integers(-9, 0), min_size=1, max_size=12), st.text(alphabet="abcé ", max_size=14))
def test_segmentations_are_best(table: dict[str, int], text: str) -> None:
    """Ties and positions that no piece reaches included; bytes stand for what has no piece."""
    table = {"▁": -9} | table  # as every such vocabulary has it
    own = [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] + [("<unk>", 0.0, pieces.UNKNOWN)] + [(p, float(s), pieces.NORMAL) for p, s in table.items()]
    codec = pieces.Codec(own)
    normal = codec.normalise(text)
    ids = codec.viterbi(normal)
    total, at = 0.0, 0
    while at < len(ids):
        if ids[at] > 256:
            total, at = total + own[ids[at]][1], at + 1
        else:
            first = ids[at]
            size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total, at = total + codec.least, at + size
    assert abs(total - plain_best(codec, table, normal)) < 1e-9
    assert codec.decode(codec.encode(text)) == text
