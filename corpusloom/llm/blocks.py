"""Documents as blocks of word hashes, and a way to ask all blocks about their keys.

A block holds the words of some neighbouring documents: the different hashes
once, and for each word its place among them. Operators that ask all other
documents something about each word or n-gram (how often it occurs) send a block's
different keys, packed, to the tasks that own their shards, and get packed
answers back in the same order; see exchanged().

Blocks and shards both grow with the input, so a block never sends a row to each
shard: beyond `fan` shards, ranges of shards first merge the requests of some
blocks, as a combiner does, and each merged request is cut again. Rows then grow
with the number of blocks, at most 2 * fan a block, and no task's share grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import discard, written
from corpusloom.llm.words import digests, exact_words, slices, tidy, trimmed

BLOCK = 3_000_000  # bytes of text
FAN = 4096  # requests that a block sends, at most


def squeezed(x: np.ndarray) -> bytes:
    """An array of fixed-size integers as compressed byte planes, with its type and length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes() if len(x) else b""
    return x.dtype.str.encode().ljust(4) + len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:4].decode().strip()), int.from_bytes(b[4:12], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[12:], max_output_size=max(1, n * kind.itemsize)), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def packed(*arrays: np.ndarray) -> bytes:
    parts = [squeezed(np.asarray(a)) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpacked(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(unsqueezed(b[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


class Block:
    """doc_id (0 where it is null), has_id, and words (its number) of each document; word: hash of each word of all documents in order."""

    def __init__(self, payload: bytes):
        self.doc_id, self.has_id, self.words, self.different, self.place = unpacked(payload)
        self.has_id = self.has_id.astype(bool)
        self.stop = np.cumsum(self.words, dtype=np.int64)
        self.start = self.stop - self.words

    @property
    def word(self) -> np.ndarray:
        return self.different[self.place]


def stored_blocks(documents: DataFrame, name: str) -> DataFrame:
    """(block, payload) of all documents, written; a block's number is fixed by being written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for rows in slices(batches, BLOCK):
            part = rows.column("part")[0].as_py()
            per_doc, different, place = exact_words(rows.column("text"), lower=True)
            hashes = digests(different)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = rows.column("doc_id").cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            payload = packed(ids.fill_null(0).to_numpy(), known.astype(np.uint8), per_doc.astype(np.int32), hashes[order], rank[place])
            yield pa.RecordBatch.from_pydict({"block": [(part << 32) + n], "payload": [payload]}, pa.schema([("block", pa.int64()), ("payload", pa.binary())]))
            n += 1

    return written(documents.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(tidy(run), "block long, payload binary"), name)


#: Of a block: the shard of each of its different keys, the keys, their counts, and further arrays about them that are the same in every block.
Keys = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]
#: What a shard's number and the keys, counts and further arrays of its requests make: arrays for each request, sums, and bytes to keep.
Answer = Callable[[int, list[list[np.ndarray]]], tuple[list[list[np.ndarray]], list[int], bytes]]
_REQUEST = pa.schema([("shard", pa.int64()), ("source", pa.int64()), ("request", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int64()), ("source", pa.int64()), ("answer", pa.binary()), ("sums", pa.list_(pa.int64()))])


def shard_of(route: np.ndarray, shards: int) -> np.ndarray:
    """Even shards of well-spread 64-bit hashes."""
    return ((route >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def asking_order(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order in which a block sends its keys, and gets its answers."""
    return np.lexsort((key, shard))


def _request(shard: np.ndarray, key: np.ndarray, arrays: list[np.ndarray]) -> bytes:
    """Keys ascend within a shard; the shards' numbers go along as runs."""
    which, first = np.unique(shard, return_index=True)
    step = np.diff(key, prepend=np.uint64(0))
    step[first] = key[first]
    return packed(which, first, step, *arrays)


def _requested(b: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(shard, key, arrays) of a request."""
    which, first, step, *arrays = unpacked(b)
    runs = np.diff(np.append(first, len(step)))
    key = np.cumsum(step, dtype=np.uint64)
    key -= np.repeat(key[first] - step[first], runs)
    return np.repeat(which, runs), key, arrays


def _cut(shard: np.ndarray, key: np.ndarray, arrays: list[np.ndarray], by: np.ndarray, source: int) -> pa.RecordBatch:
    """A row for each value of by, which ascends."""
    which, first = np.unique(by, return_index=True)
    ends = np.append(first[1:], len(by))
    requests = [_request(shard[a:b], key[a:b], [x[a:b] for x in arrays]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_pydict({"shard": which, "source": np.full(len(which), source), "request": requests}, _REQUEST)


def exchanged(blocks: DataFrame, keys: Callable[[dict], Keys], shards: int, answer: Answer, name: str, fan: int = FAN) -> tuple[DataFrame, list[int], DataFrame]:
    """Answers about the keys of every block: (source, answers) by block in asking_order(), the sums, and (shard, kept).

    keys() gets a block's row. answer() gets all requests for a shard's keys
    together, the keys of each ascending. A shard's size is bounded by the number
    of shards, which grows with the input.
    """
    levels = 1 if shards <= fan else 2
    span = -(-shards // fan) if levels == 2 else 1  # ranges of shards; as many blocks are merged in each
    wide = -(-shards // span)  # shards of a range

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trimmed()
            for row in batch.to_pylist():
                shard, key, n, more = keys(row)
                order = asking_order(shard, key)
                shard = shard[order]
                if len(shard):
                    yield _cut(shard, key[order], [x[order] for x in (n, *more)], shard if levels == 1 else shard // wide, row["block"])

    def merge(rows: pa.Table) -> pa.Table:
        """One request for each shard of a range from those of some blocks, and under shard -1 where each block's keys are in it."""
        sources, parts = rows["source"].to_pylist(), [_requested(b) for b in rows["request"].to_pylist()]
        shard, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        arrays = [np.concatenate([p[2][i] for p in parts]) for i in range(len(parts[0][2]))]
        order = asking_order(shard, key)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(shard[order]) != 0) | (np.diff(key[order]) != 0)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        arrays = [np.bincount(at, arrays[0]).astype(np.int64), *(x[first] for x in arrays[1:])]
        group, spot = int(rows["group"][0].as_py()), int(rows["shard"][0].as_py())
        places = np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])
        found = _cut(shard[first], key[first], arrays, shard[first], group)
        back = packed(np.array(sources, np.int64), np.array([len(p) for p in places]), np.concatenate(places).astype(np.int32))
        return pa.Table.from_batches([found, pa.RecordBatch.from_pydict({"shard": [-1 - spot], "source": [group], "request": [back]}, _REQUEST)])

    def own(rows: pa.Table) -> pa.Table:
        parts = [_requested(b) for b in rows["request"].to_pylist()]
        answers, sums, kept = answer(rows["shard"][0].as_py(), [[k, *arrays] for _, k, arrays in parts])
        shard = rows["shard"].to_pylist()
        return pa.Table.from_pydict({"shard": [*shard, shard[0]], "source": [*rows["source"].to_pylist(), None], "answer": [*(packed(*a) for a in answers), kept], "sums": [*[None] * len(answers), sums]}, _ANSWER)

    def back(rows: pa.Table) -> pa.Table:
        """The answers to a merged request, for each block that is in it."""
        rows = sorted(rows.to_pylist(), key=lambda r: r["shard"])
        spot, (sources, sizes, places) = -1 - rows[0]["shard"], unpacked(rows[0]["answer"])
        whole = [np.concatenate(x) for x in zip(*(unpacked(r["answer"]) for r in rows[1:]), strict=True)]
        answers = [packed(*(x[p] for x in whole)) for p in np.split(places, np.cumsum(sizes)[:-1])]
        return pa.Table.from_pydict({"shard": [spot] * len(answers), "source": sources, "answer": answers, "sums": [None] * len(answers)}, _ANSWER)

    asked, answer_schema = "shard long, source long, request binary", "shard long, source long, answer binary, sums array<long>"
    requests = blocks.mapInArrow(tidy(ask), asked)
    if levels == 2:
        grouped = requests.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(max(1, -(-blocks.count() // span)))))
        merged = written(grouped.groupBy("shard", "group").applyInArrow(merge, asked), f"{name}-merged")
        answers = written(merged.where("shard >= 0").groupBy("shard").applyInArrow(own, answer_schema), f"{name}-of-merged")
        places = merged.where("shard < 0").select("shard", "source", F.col("request").alias("answer"), F.lit(None).cast("array<long>").alias("sums"))
        range_of = F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.floor(F.col("shard") / wide))
        returned = answers.where("source is not null").unionByName(places).groupBy(range_of.alias("range"), F.col("source").alias("group")).applyInArrow(back, answer_schema)
        of_blocks = written(returned, f"{name}-answers")
        discard(merged)
    else:
        of_blocks = answers = written(requests.groupBy("shard").applyInArrow(own, answer_schema), f"{name}-answers")
    each = answers.where("source is null").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # a few numbers
    by_block = of_blocks.where("source is not null").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias("answers"))
    return by_block, [r.n for r in sorted(each)], answers.where("source is null").select("shard", F.col("answer").alias("kept"))


def answers_of(row: dict, kinds: list[np.dtype]) -> list[np.ndarray]:
    """A block's answers, in asking_order(); a block without keys has none."""
    parts = [unpacked(a["answer"]) for a in row["answers"] or []]
    return [np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds)]


def split_like(values: np.ndarray, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(p[0]) for p in parts])[:-1])
