"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths reaches the driver; it has at most
`capacity` entries however many documents there are. On it the configuration
linear program (fewest sequences, each filled by a pattern of lengths) is solved by multiplicative
weights: lengths hold prices, a knapsack dynamic program finds
the pattern worth most at these prices among the lengths with the highest price a token, and the prices of what the pattern
covers fall. The patterns' weights are rounded down to whole sequences, then those that still fit
what is left are taken once more each, and the program is solved
again for the lengths that are left, until its patterns take none. What remains, less than a sequence a pattern of the last
solution, is packed best fit, largest first, on counts. If plain best fit alone needs fewer sequences it is taken. The plan is a list of
patterns with copies. Pieces of one length are numbered in parallel (counts of
each partition, then offsets), and a piece's number tells its sequence and place.

Null texts count as empty: their only id is the end id. Longer documents are
cut into pieces of the capacity. Repeated rows are packed as often as they
occur; other columns of the input play no part. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.shared import written
from corpusloom.llm.words import Known, slices, tidy


@dataclass(frozen=True)
class Config:
    capacity: int = 4096
    end_id: int = 1
    rounds: int = 400  # of multiplicative weights, each time the program is solved
    eta: float = 0.5
    phases: int = 14  # times that the program is solved, at most
    priced: int = 128  # lengths that a knapsack chooses from, those with the highest price a token
    bucket_rows: int = 500_000  # pieces that are numbered in one task, about


# ---- token ids

CHUNK = 2_000_000  # bytes of text in a batch of results
WINDOW = 1_000_000  # characters of a text that are cut into words at once


class Encoder:
    """Ids of texts, as the tokenizer gives them for each whole text.

    This vocabulary's words never reach over white space, so a text's ids are those of
    its words, and words seen before come from a cache of bounded size. A word
    that holds only letters, digits and marks falls into runs of letters, single
    digits and runs of marks, which the tokenizer's model encodes directly. Words with any other character, and
    all texts of another vocabulary, go through the whole tokenizer.
    """

    CACHE = 40 << 20  # bytes of a generation of words, about
    # What this vocabulary's normaliser and splitter do with such characters.
    _PLAIN = r"A-Za-zÀ-ÖØ-öø-ÿ0-9.,!?;:#$%&*|()+=/_@\-"
    OTHER = re.compile(rf"[^{_PLAIN}\t-\r ]")
    PLAIN = "".join(re.findall(rf"[{_PLAIN}\t-\r ]", "".join(map(chr, range(256))))).encode("latin-1")
    PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
    WORD = re.compile(r"[^\t-\r ]+")
    SPACE = re.compile(r"[\t-\r ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # The shortcuts rest on this vocabulary's way of cutting words; any other is encoded text by text. Only these two parts of
        # the file are looked at, as the whole would be parsed anew for each task.
        said = [b"" if part is None else part.__getstate__() for part in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]
        self.parts = b"Removed" in said[0] and b"Lowercase" in said[1]
        # How the model writes the bytes of the letters beyond ASCII.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: "".join(x for x, _ in level.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100)}
        self.known = Known(self.CACHE)

    def _plain(self, word: str) -> bytes:
        """The ids of a word of plain characters in lower case, as 32-bit integers."""
        if not word.isalpha():
            pieces = self.PIECE.findall(word)
            if len(pieces) > 1:
                return b"".join(map(self.known.__getitem__, pieces))
        return array("I", [t.id for t in self.tokenize(word if word.isascii() else word.translate(self.written))]).tobytes()

    def _any(self, word: str) -> bytes:
        return self._whole(word) if self.OTHER.search(word) else self._plain(word.lower())

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _is_plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.PLAIN)
        except UnicodeEncodeError:
            return False

    def _encode(self, text: str) -> bytes:
        # Where all characters are plain, words are taken in lower case, so that the cache holds fewer.
        plain = self._is_plain(text)
        self.known.make = self._plain if plain else self._any
        return b"".join(map(self.known.__getitem__, text.lower().split() if plain else self.WORD.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        if not self.parts:
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            cut = self.SPACE.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = cut.end() if cut else len(text)
            out.append(self._encode(text[at:end]))
            at = end
        return b"".join(out)


@functools.cache
def encoder_for(path: str) -> Encoder:
    """One a worker process, with its cache."""
    return Encoder(path)


def pieces(documents: DataFrame, tokenizer_path: str, config: Config = Config(), keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row; a document's ids end with config.end_id."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * keep_ids
    end = np.array([config.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for rows in slices(batches, CHUNK):
            out = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                own = encoder.encode(text or "") + end
                for piece, start in enumerate(range(0, len(own) // 4, config.capacity)):
                    part = own[4 * start : 4 * (start + config.capacity)]
                    out.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


# ---- the plan, on counts


Pattern = tuple[tuple[int, int], ...]  # (length index, times), ascending


def best_pattern(lengths: np.ndarray, price: np.ndarray, demand: np.ndarray, capacity: int, priced: int) -> Pattern:
    """How often each length index is used in the worthiest filling: knapsack by dynamic programming.

    Only the `priced` lengths with the highest price a token are tried; the prices of what is covered fall, so that
    each has its turn. A length is used as often as it is demanded at most.
    """
    tried = np.flatnonzero(demand > 0)
    if len(tried) > priced:
        tried = tried[np.argpartition(-price[tried] / lengths[tried], priced)[:priced]]
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, int, np.ndarray]] = []  # length index, copies, their room, where they were taken
    for i in tried[np.argsort(-lengths[tried], kind="stable")].tolist():
        left, size = int(min(demand[i], capacity // lengths[i])), 1
        while left > 0:
            k = min(size, left)
            room = k * int(lengths[i])
            worth = best[:-room] + k * price[i]
            better = worth > best[room:] + 1e-13
            if better.any():
                np.copyto(best[room:], worth, where=better)
                steps.append((i, k, room, better))
            left, size = left - k, size * 2
    pattern: dict[int, int] = {}
    at = capacity
    for i, k, room, better in reversed(steps):
        if at >= room and better[at - room]:
            pattern[i] = pattern.get(i, 0) + k
            at -= room
    return tuple(sorted(pattern.items()))


def configuration_weights(lengths: np.ndarray, demand: np.ndarray, config: Config) -> list[tuple[Pattern, float]]:
    """Patterns with fractional copies: the configuration program, by multiplicative weights; the most copies first.

    Each round a knapsack finds the pattern worth most at the current prices; it
    is taken as often as eta times its scarcest length allows, and the prices of
    what it covers fall by their share of the demand. At the end a pattern's copies are
    scaled so that none of its lengths is covered more than once over.
    """
    covered, log_price = np.zeros(len(lengths)), np.zeros(len(lengths))
    weight: dict[Pattern, float] = {}
    for _ in range(config.rounds):
        pattern = best_pattern(lengths, lengths / config.capacity * np.exp(log_price - log_price.max()), demand, config.capacity, config.priced)
        i, n = np.array(pattern).T
        step = float((demand[i] / n).min()) * config.eta
        weight[pattern] = weight.get(pattern, 0.0) + step
        covered[i] += step * n
        log_price[i] -= config.eta * step * n / demand[i]
    over = covered / demand
    return sorted(((p, w / max(over[i] for i, _ in p)) for p, w in weight.items()), key=lambda x: (-x[1], x[0]))


Packed = list[tuple[int, list[tuple[int, int]]]]


def sequences(packed: Packed) -> int:
    return sum(copies for copies, _ in packed)


def by_program(lengths: np.ndarray, left: np.ndarray, config: Config) -> tuple[Packed, np.ndarray]:
    """Sequences that patterns of the program fill to the last token, and what is left of each length."""
    out, left = [], left.copy()
    for _ in range(config.phases):
        own = np.flatnonzero(left > 0)
        if not len(own):
            break
        solved = [(p, w) for p, w in configuration_weights(lengths[own], left[own].astype(float), config) if sum(int(lengths[own[i]]) * n for i, n in p) == config.capacity]
        took = 0
        for up in (False, True):  # whole copies first, then one more of what still fits
            for pattern, weight in solved:
                copies = min(1 if up else int(weight), *(int(left[own[i]]) // n for i, n in pattern))
                if copies > 0:
                    out.append((copies, [(int(lengths[own[i]]), n) for i, n in reversed(pattern)]))
                    took += copies
                    for i, n in pattern:
                        left[own[i]] -= copies * n
        if not took:
            break
    return out, left


def plan(histogram: dict[int, int], config: Config = Config()) -> Packed:
    """(copies, [(length, times)]) that hold each length exactly as often as the histogram says."""
    lengths = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return []
    filled, left = by_program(lengths, count, config)
    packed = best_fit(lengths, left, config.capacity, filled)
    plain = best_fit(lengths, count, config.capacity)
    return packed if sequences(packed) <= sequences(plain) else plain


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, begun: Packed = ()) -> Packed:
    """Largest first into the fullest sequence that has room, on groups of equal sequences rather than single ones."""
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room -> [(copies, contents)]
    for copies, held in begun:
        groups.setdefault(capacity - sum(x * n for x, n in held), []).append((copies, dict(held)))
    for length, count in sorted(zip(lengths.tolist(), left.tolist(), strict=True), reverse=True):
        while count > 0:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(count, each)
                for copies, n in ((full, each), (1, rest)):
                    if copies and n:
                        groups.setdefault(capacity - n * length, []).append((copies, {length: n}))
                break
            copies, held = groups[room].pop()
            if not groups[room]:
                del groups[room]
            each = min(room // length, max(1, count // copies))
            used = min(copies, count // each)
            groups.setdefault(room - each * length, []).append((used, held | {length: held.get(length, 0) + each}))
            if copies > used:
                groups.setdefault(room, []).append((copies - used, held))
            count -= used * each
    return [(copies, sorted(held.items(), reverse=True)) for some in groups.values() for copies, held in some]


def slots(packed: Packed) -> np.ndarray:
    """Rows (length, first piece number, times in a sequence, first sequence id, first offset) of each (pattern, length), in ascending order."""
    rows, sequence, used = [], 0, {}
    for copies, held in packed:
        offset = 0
        for length, times in held:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """rows (doc_id, piece, length, ...) with sequence_id and offset added."""
    spark = rows.sparkSession
    rows = written(rows, "packing-pieces")
    # A length may hold most pieces, so it is numbered in many buckets at once, each after the ones before it.
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // config.bucket_rows)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = written(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "packing-counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")).cast("long")
    numbered = dealt.withColumn("_nth", nth).join(before, ["length", "_bucket"]).withColumn("_number", F.col("_nth") - 1 + F.col("_before"))

    length_at, first, times, sequence, offset = slots(plan(histogram, config)).T
    key, columns = length_at * (1 << 40) + first, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            at = np.searchsorted(key, length * (1 << 40) + number, "right") - 1
            within = number - first[at]
            added = [pa.array(sequence[at] + within // times[at]), pa.array(offset[at] + within % times[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(tidy(run), StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack(documents: DataFrame, tokenizer_path: str, config: Config = Config(), keep_ids: bool = False) -> DataFrame:
    """pieces() of every row with sequence_id and offset."""
    return place(pieces(documents, tokenizer_path, config, keep_ids), config)
