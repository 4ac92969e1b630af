"""Blocks, their exchange with shards over one level and over two, and the language model against a plain one."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

pytest.importorskip("corpusloom.llm")

from corpusloom.llm import blocks as B  # noqa: E402
from corpusloom.llm import jaccard_join, ngram_lm  # noqa: E402
from corpusloom.llm.elias_fano import Monotone, Trie  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark: SparkSession) -> DataFrame:
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [None, "", "a", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    return spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("fan", [4096, 4, 1])
def test_exchange(spark: SparkSession, documents: DataFrame, monkeypatch: pytest.MonkeyPatch, fan: int) -> None:
    """Each block gets the sum of all blocks' counts for each of its keys."""
    stored = B.stored_blocks(documents, "test-blocks")
    shards = 13

    def counts(row: dict) -> B.Keys:
        block = B.Block(row["payload"])
        key, n = np.unique(block.word, return_counts=True)
        return B.shard_of(key, shards), key, n, [(key & np.uint64(7)).astype(np.int64)]

    def answer(shard: int, parts: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[int], bytes]:
        different, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        assert (B.shard_of(different, shards) == shard).all()
        assert all((p[2] == (p[0] & np.uint64(7)).astype(np.int64)).all() for p in parts)
        total = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        return [[x] for x in B.split_like(total[at], parts)], [len(different)], b"kept"

    answers, sums, kept = B.exchanged(stored, counts, shards, answer, "test-exchange", fan)
    expected: Counter[int] = Counter()
    rows = stored.collect()
    for r in rows:
        expected.update(B.Block(bytes(r.payload)).word.tolist())
    found = {r.source: r for r in answers.collect()}
    for r in rows:
        shard, key, _, _ = counts({"payload": bytes(r.payload)})
        if len(key):
            (total,) = B.answers_of({"answers": [{"answer": bytes(a.answer)} for a in found[r.block].answers]}, [np.int64])
            assert total.tolist() == [expected[k] for k in key[B.asking_order(shard, key)].tolist()]
    assert sums == [len(expected)]
    assert {bytes(r.kept) for r in kept.collect()} == {b"kept"}


@pytest.mark.parametrize("fan", [4096, 2])
def test_model_is_that_of_the_docstring(spark: SparkSession, documents: DataFrame, fan: int) -> None:
    config = ngram_lm.Config(fan=fan, shard_mb=0.002)
    held = ngram_lm.held_out_by_crc(5, 1)
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in documents.collect()]
    train = [w for d, w in rows if d is not None and not held(d)]
    padded = lambda w: ["<"] * (config.order - 1) + w + [">"]
    grams: Counter[tuple] = Counter()
    contexts: Counter[tuple] = Counter()
    unigram: Counter[str] = Counter()
    for w in train:
        t = padded(w)
        for i in range(config.order - 1, len(t)):
            unigram[t[i]] += 1
            for k in range(2, config.order + 1):
                grams[tuple(t[i - k + 1 : i + 1])] += 1
                contexts[tuple(t[i - k + 1 : i])] += 1
    total = sum(unigram.values())
    found = {r.doc_id: r for r in ngram_lm.scored(documents, held, config).collect()}
    for d, w in rows:
        score = base = 0.0
        t = padded(w)
        for i in range(config.order - 1, len(t)):
            p = (unigram[t[i]] + 0.5) / (total + 0.5 * (len(unigram) + 1))
            base += math.log10(p)
            for k in range(2, config.order + 1):
                u, mu = tuple(t[i - k + 1 : i]), config.mu[k - 2]
                p = grams[(*u, t[i])] / (contexts[u] + mu) + mu / (contexts[u] + mu) * p
            score += math.log10(p)
        r = found[d]
        assert (r.n_tokens, r.train_tokens) == (len(w) + 1, total)
        assert r.base_score == pytest.approx(base)
        # Shares are stored in 254 steps of a logarithm.
        assert r.score == pytest.approx(score, rel=0.01, abs=0.02 * len(t))
    assert found[None].held_out is None


def test_trie_against_a_dictionary() -> None:
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 1 << 16, (5000, 2)).astype(np.uint64) % np.array([300, 1 << 16], np.uint64), axis=0)
    codes = rng.integers(1, 255, len(pairs)).astype(np.uint8)
    contexts = np.unique(pairs[:, 0])
    weights = rng.integers(1, 255, len(contexts)).astype(np.uint8)
    with Trie.mapped(Trie.of(pairs[:, 0], pairs[:, 1], codes, weights).to_bytes()) as trie:
        asked = np.concatenate([pairs, rng.integers(0, 1 << 16, (5000, 2)).astype(np.uint64) % np.array([400, 1 << 16], np.uint64)])
        code, weight = trie.lookup(asked[:, 0], asked[:, 1])
    known, own = {tuple(p): c for p, c in zip(pairs.tolist(), codes.tolist(), strict=True)}, dict(zip(contexts.tolist(), weights.tolist(), strict=True))
    assert code.tolist() == [known.get(tuple(p), 0) for p in asked.tolist()]
    assert weight.tolist() == [own.get(p[0], 0) for p in asked.tolist()]
    values = np.unique(rng.integers(0, 1 << 40, 1000)).astype(np.uint64)
    assert Monotone.of(values).get(np.arange(len(values))).tolist() == values.tolist()


def test_words_that_weak_hashes_confuse(spark: SparkSession) -> None:
    """Thue-Morse words have equal polynomial hashes for any odd base modulo 2**64; documents of them are unlike."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    common = [f"w{i}" for i in range(3)]
    docs = spark.createDataFrame([(0, " ".join([a, *common, a, *common, a])), (1, " ".join([b, *common, b, *common, b]))], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.joined(docs).collect()} == {(0, 4, 0), (1, 4, 1)}
    found = {r.doc_id: r for r in ngram_lm.scored(docs, lambda d: d == 1).collect()}
    assert found[0].n_known == found[0].n_tokens == 10
    assert found[1].n_known == 7
