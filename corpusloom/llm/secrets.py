"""Secret scans: fixed patterns, and character Markov models.

Two first-order Markov chains over characters, one trained on random
strings and one on ordinary identifiers, give a token two log-likelihoods; a
token whose ratio for each character is high enough is a span of kind "markov".
The labelled samples are rows of (sample, label): by default the values that
the fixed patterns find in the documents (1), and ordinary tokens beside them
(0). Transition counts over all samples are summed by Spark; the model is a
matrix of fixed size.

A markov span is a run of SYMBOLS of least_length or more, of what the fixed
patterns' spans leave of a text, that is a likelier random string. Spans count
code points, end exclusive. Null texts count as empty; empty texts have no
spans; equal texts have equal spans; other columns of the input play no part.
Without samples of both labels there are no markov spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import slices, tidy

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 16
#: HEX finds maximal runs, so asking for the least length at once gives the same spans.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")


@dataclass(frozen=True)
class Config:
    least_length: int = 12
    ratio: float = 0.25  # nats a character
    smoothing: float = 0.5  # added to each transition's count
    least_ordinary: int = 4  # characters of a label-0 sample


STATES = len(SYMBOLS) + 1  # the last one stands for begin and end
_STATE = np.full(128, STATES - 1)
for _i, _c in enumerate(SYMBOLS):
    _STATE[ord(_c)] = _i


def states(token: str) -> np.ndarray:
    return _STATE[np.frombuffer(token.encode("ascii"), np.uint8)]


def transitions(token: str) -> np.ndarray:
    """Flat indices of the token's steps, from begin to end."""
    s = np.concatenate([[STATES - 1], states(token), [STATES - 1]])
    return s[:-1] * STATES + s[1:]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if (":" in text or "=" in text) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def markov_spans(text: str, base: list[tuple[int, int, str]], ratio: np.ndarray | None, config: Config) -> list[tuple[int, int, str]]:
    if ratio is None:
        return []
    pattern = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % config.least_length)
    found = [m.span() for part in outside(text, base) for m in pattern.finditer(text, *part)]
    if not found:
        return []
    # All tokens in one row of states, each between two states that stand for begin and end.
    row = _STATE[np.frombuffer("\n".join(["", *(text[a:b] for a, b in found), ""]).encode("ascii"), np.uint8)]
    size = np.array([b - a for a, b in found])
    total = np.add.reduceat(ratio[row[:-1] * STATES + row[1:]], np.cumsum(size + 1) - size - 1)
    return [(a, b, "markov") for (a, b), x, n in zip(found, total, size, strict=True) if x > config.ratio * n]


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def outside(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of the text that no span covers."""
    parts, at = [], 0
    for a, b, _ in sorted(spans):
        if a > at:
            parts.append((at, a))
        at = max(at, b)
    return [*parts, (at, len(text))]


_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _sampling(config: Config) -> _Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found: dict[tuple[str, int], int] = {}
            words: Counter[str] = Counter()
            for text in rows.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for a, b, kind in base:
                    value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                    value = "".join(c for c in value if c in SYMBOLS)
                    if any(c.isdigit() for c in value):
                        found[value, 1] = found.get((value, 1), 0) + 1
                words.update(" ".join([text[a:b] for a, b in outside(text, base)]).split())
            for w, n in words.items():
                for t in TOKEN.findall(w):
                    if len(t) >= config.least_ordinary and not LONG_HEX.search(t):
                        found[t, 0] = found.get((t, 0), 0) + n
            if found:
                pairs = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32()), pa.array(list(found.values()), pa.int64())], ["sample", "label", "weight"])

    return run


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, STATES * STATES))
    for whole in batches:
        for begin in range(0, len(whole), 5000):
            batch = whole.slice(begin, 5000)
            label, weight = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            # All samples in one row of states, each between two states that stand for begin and end.
            row = _STATE[np.frombuffer("\n".join(["", *batch.column("sample").to_pylist(), ""]).encode("ascii"), np.uint8)]
            of = np.cumsum(row[:-1] == STATES - 1) - 1
            step = row[:-1] * STATES + row[1:]
            for y in (0, 1):
                own = label[of] == y
                counts[y] += np.bincount(step[own], weight[of[own]], STATES * STATES)
    label, step = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(step, pa.int32()), pa.array(counts[label, step])], ["label", "step", "n"])


def _fitted(counted: DataFrame, config: Config) -> np.ndarray | None:
    rows = counted.groupBy("label", "step").agg(F.sum("n").alias("n")).collect()  # at most 2 * STATES**2 rows
    counts = np.zeros((2, STATES * STATES))
    for r in rows:
        counts[r.label, r.step] = r.n
    if not counts.sum(1).all():
        return None
    counts = counts.reshape(2, STATES, STATES) + config.smoothing
    log = np.log(counts / counts.sum(2, keepdims=True))
    return (log[1] - log[0]).ravel()


def samples(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """Labelled samples (sample, label, weight) of all documents: values of the fixed patterns, 1; every other token of some length, 0."""
    return documents.select("text").mapInArrow(tidy(_sampling(config)), "sample string, label int, weight long")


def train(samples: DataFrame, config: Config = Config()) -> np.ndarray | None:
    """Log-likelihood ratio, random over ordinary, of each transition; None without samples of both labels."""
    return _fitted(samples.mapInArrow(tidy(_counting), "label int, step int, n double"), config)


def learn(documents: DataFrame, config: Config = Config()) -> np.ndarray | None:
    """train() of the documents' samples, which are counted by the same Python worker that finds them."""
    sampling = _sampling(config)
    return _fitted(documents.select("text").mapInArrow(tidy(lambda batches: _counting(sampling(batches))), "label int, step int, n double"), config)


def scan(documents: DataFrame, ratio: np.ndarray | None, config: Config = Config()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row."""

    names = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out = []
            for text in rows.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = markov_spans(text, base, ratio, config)
                n = [sum(k == kind for *_, k in base + more) for kind in KINDS]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = [pa.array(x, pa.int64() if i < len(KINDS) else pa.string()) for i, x in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def masked(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with each span (overlapping ones as one) replaced; for an assignment, its value alone would be as secret, so the whole span goes."""
    parts, at = [], 0
    edges = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b in edges:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame, ratio: np.ndarray | None, config: Config = Config()) -> DataFrame:
    """documents with every span masked in text, and n_chars, where there is one, brought up to date. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = []
            for text in rows.column("text").to_pylist():
                if text is not None:
                    base = base_spans(text)
                    text = masked(text, joined(base + markov_spans(text, base, ratio, config)))
                texts.append(text)
            yield rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, rows.schema.field("text").type))

    out = documents.mapInArrow(tidy(run), documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
