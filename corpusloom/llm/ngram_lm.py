"""LM scoring by an interpolated n-gram model of all training documents in Elias-Fano tries.

Tokens are a text's words (A-Z in lower case) and one end. A token's probability
after a context u of k - 1 tokens is share(u, w) + weight(u) * its probability after
the context without its first token, where share(u, w) = c(u, w) / (c(u) + mu) and
weight(u) = mu / (c(u) + mu), mu being that of order k: a Dirichlet prior around the
lower order. The lowest order is the smoothed share of w in all training tokens. A
context that was never seen has weight 1.

All counts come from all training documents and none is pruned. Documents are
stored as blocks of word hashes. Each block asks the owners of shards for its words'
counts, and then for its n-grams of each order; the orders take turns, so that only one's
requests are on disk at a time. An owner adds up what all blocks
counted, builds the trie of its contexts, successors, and their quantised shares and weights,
maps it from a file, and looks the n-grams of every block up in it, trained on or
not. A context's n-grams have one owner, so that owner knows c(u); those of frequent contexts,
found in a bounded sample of blocks, are spread over many by their last token, and
c(u) is counted over all blocks first. Which contexts the sample finds changes
the balance, never a result. The vocabulary never reaches the driver.

n-grams are known by their shard, whose size is bounded, and 34 bits of the context's hash and 30 of the token's; words by their bytes' 64-bit hash.
Codes are 254 steps of a logarithm from the least share that so many tokens can give.

Null texts count as empty: their only token is the end. Rows without doc_id are
scored and not learned from, with held_out null; rows that repeat a doc_id are learned from and scored each. Other
columns of the input play no part. Without training documents all
probabilities are those of an unknown token.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import FAN, Answer, Block, Keys, answers_of, asking_order, exchanged, shard_of, split_like, stored_blocks
from corpusloom.llm.elias_fano import Trie
from corpusloom.llm.shared import input_partitions, written
from corpusloom.llm.words import mix, trimmed

STEPS = 254
BEGIN, END = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F)  # stand for hashes of the places before and after a text
_M = np.uint64(0x2545F4914F6CDD1D)
_CONTEXT, _TOKEN = np.uint64(34), np.uint64(30)  # bits


def gram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of n-grams, the hashed context's first bits above the hashed token's."""
    return (context >> (np.uint64(64) - _CONTEXT) << _TOKEN) | (token >> (np.uint64(64) - _TOKEN))


def parts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return key >> _TOKEN, key & ((np.uint64(1) << _TOKEN) - np.uint64(1))


@dataclass(frozen=True)
class Config:
    order: int = 3
    mu: tuple[float, ...] = (5.0, 1.0)  # of orders 2 and on
    shard_mb: float = 3.0  # of stored blocks, for each shard of an order
    sample_blocks: int = 64  # that frequent contexts are looked for in
    frequent: tuple[float, float] = (2e-5, 5e-4)  # share of the sample's tokens: an eighth of a shard's, within these
    fan: int = FAN


def held_out_by_crc(folds: int, held: int) -> Callable[[int], bool]:
    return lambda doc_id: zlib.crc32(str(doc_id).encode()) % folds == held


def least_log(tokens: int, mu: float) -> float:
    """Of the least share or weight that counts of so many tokens can give."""
    return float(np.log10(min(1.0, mu) / (tokens + mu + 1)))


def code_of(share: np.ndarray, least: float) -> np.ndarray:
    return (1 + np.round((np.clip(np.log10(share), least, 0) - least) / -least * (STEPS - 1))).astype(np.uint8)


def beside_weight(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Codes as steps from the contexts' weights, which most n-grams have alike, so that they pack well; 0 stays."""
    return np.where(code > 0, 1 + (code.astype(np.int16) - weight) % 255, 0).astype(np.uint8)


def code_beside(beside: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(beside > 0, (beside.astype(np.int16) - 1 + weight) % 255, 0).astype(np.uint8)


def shares(least: float) -> np.ndarray:
    """What each code stands for; 0 for code 0."""
    return np.concatenate([[0.0], 10 ** (least - least * np.arange(STEPS) / (STEPS - 1))])


class Tokens:
    """The tokens of a block: hash, document, place in the block's different words (-1 for the end), whether it is trained on, and hashed contexts of each order from 2."""

    def __init__(self, block: Block, held_out: Callable[[int], bool], order: int):
        docs, pad = len(block.words), order - 1
        self.held = [held_out(int(d)) if has else None for d, has in zip(block.doc_id, block.has_id, strict=True)]
        train = np.array([h is False for h in self.held], bool)
        size = block.words.astype(np.int64) + pad + 1
        stop = np.cumsum(size)
        row, place = np.full(stop[-1] if docs else 0, BEGIN), np.full(stop[-1] if docs else 0, -1, np.int64)
        token = np.ones(len(row), bool)
        for k in range(pad):
            token[stop - size + k] = False
        inner = token.copy()
        inner[stop - 1] = False
        row[stop - 1] = END
        row[inner], place[inner] = block.word, block.place
        at = np.flatnonzero(token)
        self.hash, self.place, self.doc = row[at], place[at], np.repeat(np.arange(docs), size - pad)
        self.train, self.docs = train[self.doc], docs
        self.train_docs = int(train.sum())
        self.contexts: dict[int, np.ndarray] = {}
        with np.errstate(over="ignore"):
            whole = np.concatenate([[BEGIN], row[:-1]])
            for k in range(2, order + 1):
                self.contexts[k] = whole[at]
                whole = mix(np.concatenate([[BEGIN], whole[:-1]]) * _M + np.concatenate([[BEGIN], row[:-1]]))


@dataclass
class Frequent:
    """Contexts of an order whose n-grams have many owners: sorted hashes, and how often each was seen in training."""

    context: np.ndarray
    total: np.ndarray

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """Their totals; 0 for all others."""
        if not len(self.context):
            return np.zeros(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.context, contexts), len(self.context) - 1)
        return np.where(self.context[at] == contexts, self.total[at], 0)


def _counted(blocks: DataFrame, held_out: Callable[[int], bool], config: Config, share: float, few: dict[int, np.ndarray] | None) -> list:
    """(order, context, n) of the training tokens' contexts: without few those that have the share of a block, with it those; order 0 has the tokens, order 1 the documents."""
    schema = pa.schema([("order", pa.int32()), ("context", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                t = Tokens(Block(payload), held_out, config.order)
                order, context, n = [np.array([0, 1])], [np.zeros(2, np.uint64)], [np.array([t.train.sum(), t.train_docs])]
                for k, own in t.contexts.items():
                    own = own[t.train]
                    if few is not None:
                        own = own[np.isin(own, few[k])]
                    c, count = np.unique(own, return_counts=True)
                    some = count >= (1 if few is not None else max(1, share * t.train.sum()))
                    order.append(np.full(some.sum(), k))
                    context.append(c[some])
                    n.append(count[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(order), pa.int32()), pa.array(np.concatenate(context).view(np.int64)), pa.array(np.concatenate(n), pa.int64())], schema=schema)

    counts = blocks.mapInArrow(run, "order int, context long, n long").groupBy("order", "context").agg(F.sum("n").alias("n"))
    if few is None:  # at most 1 / share rows an order pass
        counts = written(counts, "lm-sample")
        tokens = counts.where("order = 0").agg(F.coalesce(F.max("n"), F.lit(0)).alias("tokens"))
        counts = counts.crossJoin(F.broadcast(tokens)).where((F.col("order") < 2) | (F.col("n") >= share * F.col("tokens")))
    return counts.collect()


def frequent_contexts(blocks: DataFrame, held_out: Callable[[int], bool], config: Config, shards: int) -> tuple[int, int, dict[int, Frequent]]:
    """Training tokens, training documents, and frequent contexts by order."""
    least, most = config.frequent
    share = min(most, max(least, 1 / (8 * shards)))
    few = blocks.select("block").orderBy(F.xxhash64("block")).limit(config.sample_blocks)
    rows = _counted(blocks.join(F.broadcast(few), "block", "left_semi"), held_out, config, share, None)
    found = {k: np.sort(np.array([r.context for r in rows if r.order == k], np.int64).view(np.uint64)) for k in range(2, config.order + 1)}
    rows = _counted(blocks, held_out, config, share, found)
    total = {(r.order, r.context): r.n for r in rows}
    return total.get((0, 0), 0), total.get((1, 0), 0), {k: Frequent(c, np.array([total.get((k, x), 0) for x in c.view(np.int64).tolist()], np.int64)) for k, c in found.items()}


@dataclass
class Asked:
    """A block's different words or n-grams of an order: their shards, keys, training counts, totals of frequent contexts; and the place of each token's among them (-1 for the end among words)."""

    shard: np.ndarray
    key: np.ndarray
    n: np.ndarray
    total: np.ndarray
    at: np.ndarray

    @classmethod
    def words(cls, block: Block, t: Tokens, shards: int) -> Asked:
        word = t.place >= 0
        n = np.bincount(t.place[word], t.train[word], len(block.different)).astype(np.int64)
        return cls(shard_of(mix(block.different), shards), block.different, n, np.zeros(len(n), np.int64), t.place)

    @classmethod
    def of(cls, k: int, t: Tokens, frequent: Frequent, shards: int) -> Asked:
        context = t.contexts[k]
        key, first, at = np.unique(gram(context, t.hash), return_index=True, return_inverse=True)
        own, token = context[first], t.hash[first]
        total = frequent.of(own)
        with np.errstate(over="ignore"):
            route = mix(np.where(total > 0, own + token * _M, own))
        return cls(shard_of(route, shards), key, np.bincount(at, t.train, len(key)).astype(np.int64), total, at)

    def received(self, row: dict, answers: str, kinds: list[np.dtype]) -> list[np.ndarray]:
        """The answers in a row's column, in the order of the keys."""
        order = asking_order(self.shard, self.key)
        out = []
        for x in answers_of({"answers": row[answers]}, kinds):
            own = np.empty(len(x), x.dtype)
            own[order] = x
            out.append(own)
        return out


def trie_of(key: np.ndarray, n: np.ndarray, total: np.ndarray, mu: float, least: float) -> Trie:
    """From ascending keys (context, token), their training counts, and the totals of frequent contexts."""
    seen = n > 0
    key, n, total = key[seen], n[seen], total[seen]
    contexts, tokens = parts_of(key)
    context, first, of = np.unique(contexts, return_index=True, return_inverse=True)
    c = np.where(total[first] > 0, total[first], np.bincount(of, n, len(context)))
    return Trie.of(contexts, tokens, code_of(n / (c[of] + mu), least), code_of(mu / (c + mu), least))


def scored(documents: DataFrame, held_out: Callable[[int], bool], config: Config = Config(), keep_model: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows for which held_out(doc_id) is false. With keep_model,
    the tries are also written as a Parquet table (order, shard, trie) at that path.
    """
    blocks = stored_blocks(documents, "lm-blocks")
    shards = input_partitions(blocks, config.shard_mb)
    tokens, n_documents, frequent = frequent_contexts(blocks, held_out, config, shards)
    least = least_log(tokens, max(config.mu))

    def asker(k: int) -> Callable[[dict], Keys]:
        def keys(row: dict) -> Keys:
            block = Block(row["payload"])
            t = Tokens(block, held_out, config.order)
            a = Asked.words(block, t, shards) if k == 1 else Asked.of(k, t, frequent[k], shards)
            return a.shard, a.key, a.n, [a.total]

        return keys

    def owner(k: int) -> Answer:
        def answer(_: int, parts: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[int], bytes]:
            different, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            if k == 1:
                return [[x] for x in split_like(n[at], parts)], [int((n > 0).sum())], b""
            total, mu = np.concatenate([p[2] for p in parts])[first], config.mu[k - 2]
            stored = trie_of(different, n, total, mu, least).to_bytes()
            with Trie.mapped(stored) as trie:
                code, weight = trie.lookup(*parts_of(different))
            # A frequent context's successors may all be with other owners.
            weight = np.where(total > 0, code_of(mu / (total + mu), least), weight)
            beside = beside_weight(code, weight)
            return [list(x) for x in zip(split_like(beside[at], parts), split_like(weight[at], parts), strict=True)], [0], stored if keep_model else b""

        return answer

    with_answers, n_different = blocks, 0
    for k in range(1, config.order + 1):
        answers, sums, kept = exchanged(blocks, asker(k), shards, owner(k), f"lm-order-{k}", config.fan)
        with_answers = with_answers.join(answers.select(F.col("source").alias("block"), F.col("answers").alias(f"answers{k}")), "block", "left")
        if k == 1:
            n_different = (sums[0] if sums else 0) + (n_documents > 0)
        elif keep_model:
            kept.select(F.lit(k).alias("order"), "shard", F.col("kept").alias("trie")).write.mode("overwrite" if k == 2 else "append").parquet(keep_model)
    value = shares(least)
    value_of_weight = value.copy()
    value_of_weight[0] = 1.0  # of a context that was never seen
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trimmed()
            for row in batch.to_pylist():
                block = Block(row["payload"])
                t = Tokens(block, held_out, config.order)
                (word_count,) = Asked.words(block, t, shards).received(row, "answers1", [np.int64])
                count = np.full(len(t.hash), n_documents)
                count[t.place >= 0] = word_count[t.place[t.place >= 0]]
                unigram = (count + 0.5) / (tokens + 0.5 * (n_different + 1))
                p = unigram
                for k in t.contexts:
                    a = Asked.of(k, t, frequent[k], shards)
                    beside, weight = a.received(row, f"answers{k}", [np.uint8, np.uint8])
                    p = value[code_beside(beside, weight)[a.at]] + value_of_weight[weight[a.at]] * p
                docs = t.docs
                columns = [
                    pa.array(block.doc_id, mask=~block.has_id), pa.array(t.held, pa.bool_()), pa.array(block.words.astype(np.int64) + 1), pa.array(np.bincount(t.doc, count > 0, docs).astype(np.int64)),
                    pa.array(np.full(docs, tokens)), pa.array(np.bincount(t.doc, np.log10(unigram), docs)), pa.array(np.bincount(t.doc, np.log10(p), docs)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers.drop("block").mapInArrow(run, out)
