"""Words of many texts at once, as arrays.

Words are numpy arrays over the texts' UTF-8 bytes, with quick hashes that serve
classifiers. exact_words() tells words apart by their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes between words, as [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between letters or digits; bytes of longer code points belong to words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
CHUNK = 1_000_000
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
WINDOW = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, m, np.uint64))]) for m in (_MULTIPLIER, _INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit function of each element (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words of a list of texts.

    data: all bytes, lower-cased A-Z, a line feed before and after each text;
    start, end: of each word in data; doc: the index of its text, ascending;
    text_start, text_end: of each text in data.
    """

    def __init__(self, texts: list[bytes], between: np.ndarray = SPACE, lower: bool = True):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes + 1)
        self.text_start = self.text_end - sizes
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        inside = ~between[raw]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = change[::2], change[1::2]
        self.doc = np.searchsorted(self.text_end, self.start, "right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.hashes_to([self.end])[0]

    def hashes_to(self, ends: list[np.ndarray], some: np.ndarray | None = None) -> list[np.ndarray]:
        """For each array of ends, hashes of the words (of `some` of them, ascending) up to there: a polynomial of the bytes, taken from prefix sums, then mixed.

        Words are taken some WINDOW bytes at a time, so that the sums stay small.
        """
        starts, stops = (self.start, self.end) if some is None else (self.start[some], self.end[some])
        ends = [np.minimum(e, stops) for e in ends]
        out = [np.empty(len(starts), np.uint64) for _ in ends]
        cuts = np.searchsorted(starts, np.arange(0, len(self.data), WINDOW))
        for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
            if a == b:
                continue
            first, last = starts[a], stops[b - 1]
            power, inverse = _power_tables(last - first + 1)
            sums, s = np.zeros(last - first + 1, np.uint64), starts[a:b] - first
            with np.errstate(over="ignore"):
                np.cumsum((self.data[first:last].astype(np.uint64) + np.uint64(1)) * power[: last - first], out=sums[1:])
                for o, e in zip(out, ends, strict=True):
                    t = e[a:b] - first
                    o[a:b] = mix((sums[t] - sums[s]) * inverse[s] + (t - s).astype(np.uint64))
        return out


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that Words gives these words."""
    return Words([w.encode() for w in words]).hashes() if words else np.zeros(0, np.uint64)


class Known(dict):
    """Packed ids of words, made by `make` when first asked for.

    What is held is bounded by two generations: a full one becomes the older, the one before goes, and
    words that are asked for again are taken over. Long words are not kept.
    """

    LONGEST = 64  # characters

    def __init__(self, size: int):
        self.make: Callable[[str], bytes] = str.encode
        self.size, self.held, self.older = size, 0, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
            if len(word) > self.LONGEST:
                return ids
        if self.held > self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self[word] = ids
        self.held += 150 + len(word) + len(ids)
        return ids


def encoded(text: object) -> bytes:
    """UTF-8 of a text; a null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


TRIM = 16_000_000  # bytes of rows after which freed memory is given back


def trimmed() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Step) -> Step:
    """A task's function that gives its memory back when it is done: a worker waits for its next task, with others beside it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()  # the frame of run and all it held are gone by now

    return tidied


def slices(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows with some `size` bytes of text in all; a longer text comes alone."""
    trimmed()
    seen = 0
    for batch in batches:
        seen += batch.nbytes
        if seen > TRIM:
            trimmed()
            seen = 0
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n + 1
        if begin < len(lengths):
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of each row's text; nulls count as empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """slices() with their texts."""
    for batch in slices(batches, size):
        yield batch, texts_of(batch)


def exact_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: how many each text has, the different ones, and the place of each word among these."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = pc.list_flatten(lists)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(texts)), coded.dictionary, coded.indices.to_numpy()


def digests(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some different words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
