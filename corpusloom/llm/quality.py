"""Quality: kernel ridge scores by random Fourier features, calibrated by isotonic regression.

Each text gives a few statistics (shares of byte classes, word and line shapes).
Standardised and clipped, they pass through random cosines that approximate a
Gaussian kernel. Every labelled training row enters the normal equations: each
partition sums its own, the sums are added up in groups of bounded number, and
only a fixed number of fixed-size sums reaches the driver. Scores of the
calibration rows are counted in a fixed number of bins by Spark, and isotonic
regression of the label on the bin makes them probabilities.

Null texts count as empty; an empty text has all-zero statistics; equal texts
score equally; other columns of the input play no part. Rows whose label or id
is null are not learned from. Without training rows all texts score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import written
from corpusloom.llm.words import Words, chunks, tidy

THRESHOLD = 0.7
STATISTICS = (
    "upper", "lower", "digit", "space", "line_feed", "beyond_ascii", "full_stop_comma", "bar", "exclamation", "hash_like",
    "other_mark", "log_words", "word_length", "word_length_spread", "mixed_words", "words_per_line", "log_bytes", "repeats",
)


@dataclass(frozen=True)
class Config:
    features: int = 192
    bandwidth: float = 4.0  # of the kernel, in standard deviations
    ridge: float = 1e-3  # for each training row
    clip: float = 5.0
    bins: int = 512
    groups: int = 16  # sums that reach the driver
    seed: int = 11


def _classes() -> np.ndarray:
    table = np.full(256, 10)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 5
        elif c.isupper():
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isdigit():
            table[b] = 2
        elif c == "\n":
            table[b] = 4
        elif c.isspace():
            table[b] = 3
        elif c in ".,":
            table[b] = 6
        elif c == "|":
            table[b] = 7
        elif c == "!":
            table[b] = 8
        elif c in "#$%&*":
            table[b] = 9
    return table


CLASSES = _classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """(text, statistic), in the order of STATISTICS."""
    w = Words(texts)
    n, size = len(texts), (w.text_end - w.text_start).astype(float)
    doc_of_byte = np.repeat(np.arange(n), w.text_end - w.text_start + 1)
    kinds = CLASSES[w.raw[1:]]
    counts = np.bincount(doc_of_byte * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    counts[:, 4] -= 1  # the line feed after each text
    per_byte = counts / np.maximum(size, 1)[:, None]
    words = w.per_doc.astype(float)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    marks = np.concatenate([[0], np.cumsum(np.isin(CLASSES[w.raw], (7, 8, 9, 10)))])
    mixed = np.bincount(w.doc, marks[w.end] > marks[w.start], n) / np.maximum(words, 1)
    keys = w.hashes()
    different = np.bincount(_firsts(w.doc, keys), minlength=n)
    return np.column_stack([per_byte, np.log1p(words), mean, spread, mixed, np.log1p(words / (counts[:, 4] + 1)), np.log1p(size), 1 - different / np.maximum(words, 1)])


def _firsts(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """doc of each different (doc, key)."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    return d[np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])] if len(d) else d


def with_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            stats = statistics(texts)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), values], ["doc_id", "stats"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """(row, statistic) of a batch's stats."""
    return batch.column("stats").flatten().to_numpy().reshape(len(batch), len(STATISTICS))


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means that never fall, nearest in weighted squares: pool adjacent violators."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total, strict=True):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.repeat([t / w if w else 0.5 for w, t, _ in blocks], [int(n) for *_, n in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    levels: np.ndarray | None = None  # probability of each bin

    def lift(self, stats: np.ndarray, config: Config) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -config.clip, config.clip)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / config.features) * np.cos(z @ self.omega + self.phase)])

    def ridge_score(self, stats: np.ndarray, config: Config) -> np.ndarray:
        return self.lift(stats, config) @ self.beta

    def probability(self, stats: np.ndarray, config: Config) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), 0.5)
        return self.levels[bin_of(self.ridge_score(stats, config), config)]


def bin_of(score: np.ndarray, config: Config) -> np.ndarray:
    """Scores of a 0/1 label lie about 0 to 1; the bins cover -0.5 to 1.5."""
    return np.clip(((score + 0.5) / 2 * config.bins).astype(np.int64), 0, config.bins - 1)


def fit(rows: DataFrame, config: Config = Config()) -> Model:
    """Learn from (stats, label, use), use being "fit" or "calibrate"."""
    k = len(STATISTICS)
    moments = rows.where("use = 'fit'").agg(*[f(F.col("stats")[i]) for i in range(k) for f in (F.mean, F.stddev_pop)]).first()
    mean, scale = np.array([m if m is not None else 0 for m in moments[::2]], float), np.array([s or 1.0 for s in moments[1::2]], float)
    rng = np.random.default_rng(config.seed)
    model = Model(mean, scale, rng.normal(0, 1 / config.bandwidth, (k, config.features)), rng.uniform(0, 2 * np.pi, config.features))
    wide = config.features + 1

    def partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((wide, wide + 2)), 0
        for batch in batches:
            if len(batch):
                part = batch.column("part")[0].as_py()
                phi = model.lift(_matrix(batch), config)
                y = batch.column("label").to_numpy()
                total[:, :wide] += phi.T @ phi
                total[:, wide] += phi.T @ y
                total[0, wide + 1] += len(y)
        if total[0, wide + 1]:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], ["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column("sums").to_pylist():
                own = np.frombuffer(b)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["part", "sums"])

    schema = "part int, sums binary"
    sums = rows.where("use = 'fit'").select("stats", "label", F.spark_partition_id().alias("part")).mapInArrow(tidy(partition_sums), schema)
    sums = sums.repartition(config.groups, "part").mapInArrow(tidy(added), schema)
    gathered = [np.frombuffer(r.sums).reshape(wide, wide + 2) for r in sums.collect()]
    if not gathered:
        return model
    total = np.sum(gathered, axis=0)
    n = total[0, wide + 1]
    penalty = config.ridge * n * np.eye(wide)
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(total[:, :wide] + penalty, total[:, wide])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                b = bin_of(model.ridge_score(_matrix(batch), config), config)
                n, total = np.bincount(b, minlength=config.bins), np.bincount(b, batch.column("label").to_numpy(), config.bins)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some].astype(float)), pa.array(total[some])], ["bin", "weight", "total"])

    counts = rows.where("use = 'calibrate'").select("stats", "label").mapInArrow(tidy(binned), "bin long, weight double, total double")
    bins = counts.groupBy("bin").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).collect()
    weight, sums = np.zeros(config.bins), np.zeros(config.bins)
    for r in bins:
        weight[r.bin], sums[r.bin] = r.weight, r.total
    # Half a row in all, at the mean, keeps bins without rows defined and between their neighbours.
    share = sums.sum() / weight.sum() if weight.sum() else total[0, wide] / n
    model.levels = isotonic(weight + 0.5 / config.bins, sums + 0.5 / config.bins * share)
    return model


def score(stats: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """(doc_id, score, predicted) from (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = model.probability(_matrix(batch), config)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def learn(stats: DataFrame, labels: DataFrame, fit_rows: Column, calibrate_rows: Column, config: Config = Config()) -> Model:
    """Learn from (doc_id, stats) and labels, where the two columns over doc_id hold."""
    use = F.when(fit_rows, "fit").when(calibrate_rows, "calibrate")
    rows = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).withColumn("use", use).where("use is not null")
    return fit(written(stats.join(rows, "doc_id").select("stats", "label", "use"), "quality-rows"), config)


def fit_and_score(documents: DataFrame, labels: DataFrame, fit_rows: Column, calibrate_rows: Column, config: Config = Config()) -> DataFrame:
    """Score every row of documents."""
    stats = written(with_statistics(documents), "quality-stats")
    return score(stats, learn(stats, labels, fit_rows, calibrate_rows, config), config)


def kept(documents: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """The rows of documents that are predicted to be of quality, as they are; all of them, if there was nothing to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield rows if model.beta is None else rows.filter(pa.array(model.probability(statistics(texts), config) >= THRESHOLD))

    return documents.mapInArrow(tidy(run), documents.schema)
