"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share.

A document's set is its different shingles of `size` words (A-Z in lower case);
with fewer words, the whole sequence as one; without words, empty and linked with
nothing. Documents with equal sets are one class, whose members are linked.

Classes are joined by rare-first prefix filtering. How many classes hold a
shingle is asked of the tasks that own ranges of a key of its hash's first bits, more
of them for more blocks; a shingle that only one holds can't be shared and is dropped. A class's shingles in order of
rarity, then hash, give a prefix such that similar classes share one of its
shingles. Pairs with a common prefix shingle pass the length and positional
filters (shingles that only one class holds count as no possible match) and a
parity sketch's bound on how far two sets differ, then the suffix filter on both whole sets (a bound from how the hashes
fall into ranges), and are verified once by counting the intersection.

Groups around a prefix shingle are never expanded into all their pairs: first
each class is compared with one anchor, that of a group that it is in (the one whose
shingle hashes least, so that alike classes choose alike), then with the anchors of all its groups that
it isn't connected with, then only pairs of which the two are not yet connected. Links within a component found so far can't change it, so
none between different texts is lost for the components.

Shingles are 64-bit hashes of words' hashes; words are told apart by their bytes.
Null texts count as empty. Rows without doc_id get their size and are linked
with nothing; rows that repeat a doc_id get a row each. Other columns of the input
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import FAN, Block, Keys, answers_of, exchanged, shard_of, split_like, stored_blocks
from corpusloom.llm.components import components
from corpusloom.llm.shared import discard, input_partitions, written
from corpusloom.llm.words import mix, tidy, trimmed

@dataclass(frozen=True)
class Config:
    size: int = 5
    percent: int = 75
    shard_mb: float = 6.0  # of stored blocks, for each shard of keys
    single: int = 2  # comparisons of each class with one anchor
    rounds: int = 2  # and then with the anchors of all its groups, before the remaining pairs
    fan: int = FAN


def shingles(block: Block, size: int) -> list[np.ndarray]:
    """Each document's different shingle hashes in ascending order."""
    word, out = block.word, []
    with np.errstate(over="ignore"):
        if len(word) >= size:
            m = np.uint64(0x2545F4914F6CDD1D)
            h = word[: len(word) - size + 1].copy()
            for k in range(1, size):
                h = h * m + word[k : len(word) - size + 1 + k]
            h = mix(h)
        for a, b in zip(block.start, block.stop, strict=True):
            if b - a >= size:
                out.append(np.unique(h[a : b - size + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for w in word[a:b]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(mix(np.array([whole])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x51ED270B, 0x6C62272E07BB0142))


def least_overlap(n: int, m: int, percent: int) -> int:
    """How many common shingles sets of n and m need."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


#: Where the suffix filter divides hashes.
_RANGES = np.array([k << 60 for k in range(1, 16)], np.uint64)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets overlap enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    need = least_overlap(len(x), len(y), percent)
    counts = [np.append(np.diff(np.concatenate([[0], np.searchsorted(s, _RANGES)])), len(s) - np.searchsorted(s, _RANGES[-1])) for s in (x, y)]
    if np.minimum(*counts).sum() < need:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum()) >= need


SKETCH = [f"s{i}" for i in range(8)]


def sketch(s: np.ndarray) -> np.ndarray:
    """512 bits: whether each bucket of hashes holds an odd number. Sets that differ in d elements differ in d bits at most."""
    odd = np.bincount((s >> np.uint64(8)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(blocks: DataFrame, config: Config) -> DataFrame:
    """(block, place, doc_id, n, s1, s2) of every document: size and signature of its set."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["payload"])
                sets = shingles(block, config.size)
                signs = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(block.doc_id, mask=~block.has_id), pa.array(n), pa.array(signs[:, 0]), pa.array(signs[:, 1])], schema=schema)

    return blocks.mapInArrow(tidy(run), "block long, place int, doc_id long, n long, s1 long, s2 long")


def _rarity(_: int, parts: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[int], bytes]:
    """0 for a key that one set holds, else more for more sets, in eighths of powers of two."""
    _, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
    level = np.where(total > 1, np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)
    return [[v] for v in split_like(level[at], parts)], [], b""


def joined(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    blocks = stored_blocks(documents, "jaccard-blocks")
    shards = input_partitions(blocks, config.shard_mb)
    bits = min(64, 36 + shards.bit_length())
    sets = written(sets_of(blocks, config), "jaccard-sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "block", "place")).alias("first"))
    chosen = classes.select(F.col("first.block").alias("block"), F.struct(F.col("first.place").alias("place"), F.col("first.doc_id").alias("rep")).alias("c")).groupBy("block").agg(F.collect_list("c").alias("chosen"))

    def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        # Copies within the block count once; copies elsewhere make a shingle look less rare, which loses nothing.
        own = {signature(s): s for s in sets}
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]) >> np.uint64(64 - bits), return_counts=True)

    def keys(row: dict) -> Keys:
        key, n = keys_of(shingles(Block(row["payload"]), config.size))
        return shard_of(key << np.uint64(64 - bits), shards), key, n.astype(np.int32), []

    answers, _, _ = exchanged(blocks, keys, shards, _rarity, "jaccard-rarity", config.fan)
    numbers = ["key", "rep", "n", "position", "rest", *SKETCH]
    schema = pa.schema([*((c, pa.int64()) for c in numbers), ("hashes", pa.binary())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trimmed()
            for row in batch.to_pylist():
                all_sets = shingles(Block(row["payload"]), config.size)
                key, _ = keys_of(all_sets)
                (rarity,) = answers_of(row, [np.uint8])  # shards ascend with keys, so both are in ascending order
                spots: list[np.ndarray] = []  # (number, entry) of each class
                whole: list[tuple[int, int, bytes]] = []
                for c in row["chosen"]:
                    s, rep = all_sets[c["place"]], c["rep"]
                    rare = rarity[np.searchsorted(key, s >> np.uint64(64 - bits))]
                    first = np.lexsort((s, rare))[: prefix_length(len(s), config.percent)]
                    position = np.flatnonzero(rare[first] > 0)
                    if len(position):
                        entry = np.empty((len(numbers), len(position)), np.int64)
                        entry[0], entry[1], entry[2] = s[first[position]].view(np.int64), rep, len(s)
                        entry[3], entry[4], entry[5:] = position - position[0], len(s) - 1 - position, sketch(s)[:, None]
                        spots.append(entry)
                        whole.append((rep, len(s), s.tobytes()))
                if spots:
                    table = np.concatenate(spots, axis=1)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, table), pa.nulls(table.shape[1], pa.binary())], schema=schema)
                    reps, sizes, hashes = zip(*whole, strict=True)
                    zero = pa.array(np.zeros(len(reps), np.int64))
                    yield pa.RecordBatch.from_arrays([zero, pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), *[zero] * (len(numbers) - 3), pa.array(hashes, pa.binary())], schema=schema)

    with_answers = blocks.join(chosen, "block").join(answers.withColumnRenamed("source", "block"), "block")
    found = written(with_answers.mapInArrow(tidy(prefixes), ", ".join(f"{c} long" for c in numbers) + ", hashes binary"), "jaccard-prefixes")
    discard(blocks)
    entries, whole = found.where("hashes is null").select("key", "rep", "n", "position", "rest", F.struct(SKETCH).alias("sketch")), found.where("hashes is not null").select("rep", "hashes")
    # A shingle in one prefix only leads nowhere.
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    entries = written(entries.join(shared, "key", "left_semi"), "jaccard-entries")
    fields = F.struct("key", "n", "position", "rest", "sketch")
    chosen_entries = entries.groupBy("rep").agg(*[F.min_by(fields, F.xxhash64("key", F.lit(k))).alias(f"e{k}") for k in range(max(1, config.single))])
    chosen_entries = written(chosen_entries, "jaccard-chosen-entries")
    whole = written(whole.join(chosen_entries.select("rep"), "rep", "left_semi"), "jaccard-sets-of-entries")
    discard(found)

    tried, links, labels = None, None, None
    anchored = config.single + config.rounds
    for step in range(anchored + 1):
        asked = chosen_entries.select("rep", f"e{step}.*") if step < config.single else entries
        marked = asked if labels is None else asked.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
        marked = marked.withColumn("label", F.col("rep") if labels is None else F.coalesce("component", "rep")).select("key", "rep", "n", "position", "rest", "sketch", "label")
        if step < anchored:
            # A text that others are copies of has few shingles of its own, so fewer come before a shared one: it is the anchor, but in the last round.
            order = F.struct(F.col("n") - F.col("rest") if step < anchored - 1 else F.lit(0).cast("long"), F.xxhash64("rep", F.lit(step)))
            anchors = marked.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "n", "position", "rest", "sketch", "label")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "x")
            pairs = marked.join(anchors, "key").select(*_pair(""), *_pair("x.", "2"))
        else:
            open_keys = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            rest = marked.join(open_keys, "key", "left_semi")
            other = rest.select("key", F.struct("rep", "n", "position", "rest", "sketch", "label").alias("x"))
            pairs = rest.join(other, "key").where("rep < x.rep").select(*_pair(""), *_pair("x.", "2"))
        need = F.ceil(F.lit(config.percent) * (F.col("n") + F.col("n2")) / F.lit(100 + config.percent))
        pairs = (
            pairs.where("label <> label2")
            .where(100 * F.least("n", "n2") >= config.percent * F.greatest("n", "n2"))
            .where(F.least("p", "p2") + 1 + F.least("rest", "rest2") >= need)
            .where(sum(F.bit_count(F.col(f"sketch.{c}").bitwiseXOR(F.col(f"sketch2.{c}"))) for c in SKETCH) <= F.col("n") + F.col("n2") - 2 * need)
            .select(F.greatest("r", "r2").alias("a"), F.least("r", "r2").alias("b")).distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        result = written(_verified(pairs, whole, config), "jaccard-pairs")
        tried = result.select("a", "b") if tried is None else tried.union(result.select("a", "b"))
        found_links = result.where("linked").select("a", "b")
        links = found_links if links is None else links.union(found_links)
        if not found_links.isEmpty():
            labels = components(links if labels is None else found_links.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a > b")))
    by_class = classes.select("n", "s1", "s2", F.col("first.doc_id").alias("rep"))
    if labels is not None:
        by_class = by_class.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("rep"))
    of_row = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return sets.join(by_class, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), of_row.alias("component_id"))


def one_of_each(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of documents without those linked with a smaller doc_id; of rows that repeat a doc_id and its text, but for case, one stays.

    Rows without words are linked with nothing, so they stay, as do rows without
    doc_id. A doc_id that repeats with other texts stays if any of them does.
    """
    found = written(joined(documents, config), "jaccard-found")
    by_id = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component"), F.count("*").alias("c")), "jaccard-ids")
    gone = by_id.where("component < doc_id").select("doc_id")
    staying, asked = parted(documents, gone)
    # An anti join would be moved below the one with the bits, and take all texts along.
    found_gone = asked.join(gone.withColumn("_gone", F.lit(True)), "doc_id", "left").where("_gone is null")
    out = staying.union(found_gone.select(documents.columns))
    repeated = by_id.where("c > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    single = out.join(repeated, "doc_id", "left_anti").select(documents.columns)
    hashed = out.join(repeated, "doc_id", "left_semi").withColumn("_lower_case", F.sha2(F.lower("text"), 256))
    return single.union(hashed.dropDuplicates(["doc_id", "_lower_case"]).select(documents.columns))


WORDS = 512  # of 64 bits in a row of bits
ROWS = 1024  # of bits at most, 4 MB in all


def parted(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of documents whose doc_id is surely none of these different ids, and the others, nearly all of which are.

    Each id sets one of 16 bits an id, in a broadcast table of bounded size, so a join with the ids need not move the texts of all rows.
    With more ids than fit its size, more rows are among the others.
    """
    spark = documents.sparkSession
    rows = max(1, min(ROWS, -(-16 * ids.count() // (64 * WORDS))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(rows * WORDS))
    bit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).cast("int")
    set_bits = ids.select(place.alias("id"), bit.alias("bit")).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
    words = spark.range(rows * WORDS).join(set_bits, "id", "left").select(F.floor(F.col("id") / WORDS).alias("_row"), F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("w"))
    bits = written(words.groupBy("_row").agg(F.sort_array(F.collect_list("w"))["word"].alias("_bits")), "jaccard-gone-bits")
    dealt = documents.withColumns({"_place": place, "_row": F.floor(place / WORDS), "_bit": bit}).join(F.broadcast(bits), "_row", "left")
    hit = F.col("doc_id").isNotNull() & F.expr(f"(shiftright(_bits[cast(_place % {WORDS} as int)], _bit) & 1L) = 1")
    return tuple(dealt.where(which).select(documents.columns) for which in (~hit, hit))


def _pair(of: str, suffix: str = "") -> list:
    return [F.col(f"{of}{c}").alias(f"{name}{suffix}") for c, name in (("rep", "r"), ("n", "n"), ("position", "p"), ("rest", "rest"), ("sketch", "sketch"), ("label", "label"))]


def _verified(pairs: DataFrame, whole: DataFrame, config: Config) -> DataFrame:
    """(a, b, linked) of each pair. A pair's first set travels to the second's task; skewed ids are split by the joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            linked = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), config.percent) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(whole.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(whole.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, linked boolean")
