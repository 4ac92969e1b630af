"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits, A-Z in lower case. A word and its
beginnings of 4 to 8 bytes are its features; those that enough documents of the
training sample hold fall into hashed buckets, each with an embedding, and a
word is embedded as the sum. Filters of several
widths slide over the embeddings, each is max-pooled over the whole text, and a
logistic layer reads the pools. Training is mini-batch Adam in numpy on a
bounded sample of labelled rows, collected to the driver; the model has a fixed
size and goes to the tasks in the closure of a mapInArrow.

Thresholds are calibrated by language: on held-back sample rows each guessed
language (from the text's own common words) gets the probability that separates
best, and scores are shifted in log-odds so that it lies at 0.7.

Null texts count as empty; an empty text scores the model's value of empty
pools; equal texts score equally; other columns of the input play no part. With
no labelled rows, or only one label, all texts score a constant: that label's
smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import language
from corpusloom.llm.shared import labelled_sample
from corpusloom.llm.words import PUNCTUATION, Words, chunks, encoded, tidy

THRESHOLD = 0.7
SLICE = 300_000  # bytes of text that are scored at once
WINDOWS = 50_000  # positions of a filter whose values are in memory at once, however long a text is


@dataclass(frozen=True)
class Config:
    sample_rows: int = 6000  # at most so many labelled rows are learned from
    sample_mb: float = 48.0  # and so much of their texts
    buckets: int = 1 << 16
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8)  # bytes
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    least_docs: int = 6  # sample documents that hold a feature, for it to have an embedding
    epochs: int = 4
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    held_back: int = 5  # every fifth sample row sets thresholds
    seed: int = 7


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of features with an embedding
    tables: dict[int, np.ndarray]  # by width: (offset, bucket, filter), embedding times filter
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(language.NAMES), THRESHOLD))


def features(words: Words, beginnings: tuple[int, ...], some: np.ndarray | None = None) -> np.ndarray:
    """(word, feature) hashes, of some words or all: of the word itself and of its beginnings; 0 where it is no longer than that."""
    start, end = (words.start, words.end) if some is None else (words.start[some], words.end[some])
    whole, *parts = words.hashes_to([end, *(start + n for n in beginnings)], some)
    return np.stack([whole, *(np.where(end - start > n, h ^ np.uint64(n), np.uint64(0)) for n, h in zip(beginnings, parts, strict=True))], 1)


def buckets_of(hashes: np.ndarray, known: np.ndarray, buckets: int) -> np.ndarray:
    """1.. for known features, 0 for others."""
    if not len(known):
        return np.zeros(hashes.shape, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, (hashes % np.uint64(buckets - 1)).astype(np.int64) + 1, 0)


def _padded(ids: np.ndarray, doc: np.ndarray, docs: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one row of ids, `gap` zeros before each and after the last; where each begins."""
    row = np.zeros((len(ids) + gap * (docs + 1), *ids.shape[1:]), np.int64)
    row[np.arange(len(ids)) + gap * (doc + 1)] = ids
    counts = np.bincount(doc, minlength=docs)
    return row, gap + np.concatenate([[0], np.cumsum(counts + gap)[:-1]]) if docs else np.zeros(0, np.int64)


def pools(row: np.ndarray, begin: np.ndarray, tables: dict[int, np.ndarray], bias: dict[int, np.ndarray], gap: int) -> np.ndarray:
    """Max-pooled filters of each document. A window may reach into the zeros beside its document; an empty document has one window of zeros."""
    found = []
    for width, table in tables.items():
        # Only windows that hold a word differ from a window of zeros.
        known = np.flatnonzero(row)
        starts = np.unique((known[:, None] - np.arange(width)).ravel())
        starts = starts[(starts >= gap - width + 1) & (starts >= 0) & (starts < len(row) - width + 1)]
        best = np.zeros((len(begin), table.shape[2]), table.dtype)
        for some in np.array_split(starts, -(-len(starts) // WINDOWS)) if len(starts) else []:
            value = sum(table[k][row[some + k]] for k in range(width))
            doc = np.searchsorted(begin - width + 1, some, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            best[doc[first]] = np.maximum(best[doc[first]], np.maximum.reduceat(value, first))
        found.append(np.maximum(best + bias[width], 0))
    return np.concatenate(found, 1)


def raw_logits(model: Model, words: Words, hashes: np.ndarray, docs: int, config: Config) -> np.ndarray:
    """Each different word has its features taken and goes through the tables once."""
    gap, doc = max(config.widths), words.doc
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(first)
    spots = np.empty((len(first), 1 + len(config.beginnings)), np.int64)
    spots[order] = buckets_of(features(words, config.beginnings, first[order]), model.known, config.buckets)
    tables = {}
    for width, table in model.tables.items():
        own = np.zeros((width, len(first) + 1, table.shape[2]), table.dtype)
        for k in range(width):
            for column in spots.T:
                own[k, 1:] += table[k][column]
        tables[width] = own
    row, begin = _padded(ids + 1, doc, docs, gap)
    return pools(row, begin, tables, model.bias, gap) @ model.out + model.out_bias


def scores(model: Model, texts: list[bytes], config: Config) -> np.ndarray:
    words = Words(texts, PUNCTUATION)
    hashes = words.hashes()
    logit = raw_logits(model, words, hashes, len(texts), config)
    cut = model.thresholds[language.guess(hashes, words.doc, len(texts))]
    z = logit - np.log(cut / (1 - cut)) + np.log(THRESHOLD / (1 - THRESHOLD))
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the probabilities around the split with the fewest errors; among equals the widest gap."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    edge = np.concatenate([[1e-4], p, [1 - 1e-4]])
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    gap = edge[1:] - edge[:-1]
    k = max(np.flatnonzero(errors == errors.min()), key=lambda i: gap[i])
    return float(np.clip((edge[k] + edge[k + 1]) / 2, 1e-4, 1 - 1e-4))


def common_features(texts: list[bytes], config: Config) -> np.ndarray:
    """Sorted features that at least config.least_docs texts hold; counts are merged every few texts to stay small."""
    keys, df, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for i, t in enumerate(texts):
        waiting.append(np.unique(features(Words([t], PUNCTUATION), config.beginnings)))
        if len(waiting) == 200 or i == len(texts) - 1:
            merged, at = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            df = np.bincount(at, weights=np.concatenate([df, np.ones(len(at) - len(keys))]))
            keys, waiting = merged, []
    return keys[(df >= config.least_docs) & (keys > 0)]


def train(texts: list[bytes], y: np.ndarray, config: Config = Config()) -> Model:
    """Fit the network to texts labelled 0 or 1."""
    y = np.asarray(y, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = Model(np.zeros(0, np.uint64), {w: np.zeros((w, 1, config.filters)) for w in config.widths}, {w: np.zeros(config.filters) for w in config.widths}, np.zeros(len(config.widths) * config.filters), float(np.log(share / (1 - share))))
    if not len(y) or y.sum() in (0, len(y)):
        return constant
    rng = np.random.default_rng(config.seed)
    known = common_features(texts, config)
    ids = [buckets_of(features(Words([t], PUNCTUATION), config.beginnings), known, config.buckets).astype(np.int32) for t in texts]
    fit = np.flatnonzero(np.arange(len(y)) % config.held_back > 0)
    held = np.flatnonzero(np.arange(len(y)) % config.held_back == 0)

    gap = max(config.widths)
    p = {"E": rng.normal(0, 0.1, (config.buckets, config.dim)), "out": rng.normal(0, 0.3, len(config.widths) * config.filters), "out_bias": np.array([np.log(share / (1 - share))])}
    p["E"][0] = 0
    for w in config.widths:
        p[f"W{w}"], p[f"b{w}"] = rng.normal(0, (2 / (w * config.dim)) ** 0.5, (w, config.dim, config.filters)), np.zeros(config.filters)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(config.epochs):
        order = rng.permutation(fit)
        for batch in np.array_split(order, max(1, len(order) // config.batch)):
            doc = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            row, begin = _padded(np.concatenate([ids[i] for i in batch]), doc, len(batch), gap)
            ends = np.concatenate([begin[1:] - gap, [len(row) - gap]])
            grads = {k: np.zeros_like(x) for k, x in p.items() if k != "E"}
            touched: list[tuple[np.ndarray, np.ndarray]] = []  # buckets, and the gradient of each
            used, pooled, where = p["E"][row].sum(1), [], []
            for w in config.widths:
                n = len(row) - w + 1
                conv = sum(used[k : n + k] @ p[f"W{w}"][k] for k in range(w))
                best = np.stack([np.maximum(0, begin[d] - w + 1) + conv[max(0, begin[d] - w + 1) : max(ends[d], begin[d] - w + 2)].argmax(0) for d in range(len(batch))])
                where.append(best)
                pooled.append(np.take_along_axis(conv, best, 0) + p[f"b{w}"])
            z = np.concatenate(pooled, 1)
            a = np.maximum(z, 0)
            q = 1 / (1 + np.exp(-np.clip(a @ p["out"] + p["out_bias"][0], -30, 30)))
            g = weight[batch] * (q - y[batch]) / len(batch)
            grads["out"], grads["out_bias"][0] = a.T @ g, g.sum()
            back = g[:, None] * p["out"] * (z > 0)
            for j, w in enumerate(config.widths):
                b = back[:, j * config.filters : (j + 1) * config.filters]
                grads[f"b{w}"] = b.sum(0)
                for k in range(w):
                    spot = row[where[j] + k]  # (document, filter) -> buckets
                    grads[f"W{w}"][k] = np.einsum("df,dfe->ef", b, p["E"][spot].sum(2))
                    g_spot = np.broadcast_to((b[:, :, None] * p[f"W{w}"][k].T[None])[:, :, None], (*spot.shape, config.dim))
                    touched.append((spot[spot > 0], g_spot[spot > 0]))
            at, back_to = np.unique(np.concatenate([t for t, _ in touched]), return_inverse=True)
            grads["E"] = np.zeros((len(at), config.dim))
            np.add.at(grads["E"], back_to, np.concatenate([g for _, g in touched]))
            step += 1
            for k, x in p.items():
                own = at if k == "E" else slice(None)  # embeddings that no pool chose stay as they are
                gk = grads[k] + (config.decay * x[own] if x.ndim > 1 else 0)
                m[k][own] = 0.9 * m[k][own] + 0.1 * gk
                v[k][own] = 0.99 * v[k][own] + 0.01 * gk * gk
                x[own] -= config.rate * (m[k][own] / (1 - 0.9**step)) / (np.sqrt(v[k][own] / (1 - 0.99**step)) + 1e-8)
    model = Model(
        known,
        {w: np.stack([p["E"] @ p[f"W{w}"][k] for k in range(w)]).astype(np.float32) for w in config.widths},
        {w: p[f"b{w}"] for w in config.widths}, p["out"], float(p["out_bias"][0]),
    )

    def probability(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, tongue = [np.zeros(0)], [np.zeros(0, np.int64)]
        for i in rows:
            w = Words([texts[i]], PUNCTUATION)
            hashes = w.hashes()
            q.append(1 / (1 + np.exp(-np.clip(raw_logits(model, w, hashes, 1, config), -30, 30))))
            tongue.append(language.guess(hashes, w.doc, 1))
        return np.concatenate(q), np.concatenate(tongue)

    q, tongue = probability(held)
    if 0 < y[held].sum() < len(held):
        model.thresholds[:] = _best_cut(q, y[held])
        for k in range(len(language.NAMES)):
            own = tongue == k
            if 15 <= y[held][own].sum() < own.sum():
                model.thresholds[k] = _best_cut(q[own], y[held][own])
    return model


def fit(documents: DataFrame, labels: DataFrame, train_rows: Column, config: Config = Config()) -> Model:
    """Learn from at most config.sample_rows labelled documents for which train_rows holds, and config.sample_mb of their texts."""
    rows = sorted((r.doc_id, encoded(r.text), r.label) for r in labelled_sample(documents, labels, "toxic", train_rows, config.sample_rows, config.sample_mb).collect())
    return train([t for _, t, _ in rows], np.array([y for *_, y in rows], float), config)


def score(documents: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, SLICE):
            s = scores(model, texts, config)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def kept(documents: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """The rows of documents that aren't predicted toxic, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, SLICE):
            yield rows.filter(pa.array(scores(model, texts, config) < THRESHOLD))

    return documents.mapInArrow(tidy(run), documents.schema)
