"""Phrases mined by Toivonen's method, with exact counts and association scores.

Texts (A-Z in lower case) are cut into pieces at marks and line ends, and pieces
into words. A phrase is a run of words of one piece; all counts are per language.

A sample of documents proposes the phrases that are common in it at a lowered
threshold. A full pass then counts, in all documents, every word, and every longer
phrase whose two parts (without its last word, and without its first) are proposed:
that is what was proposed and its negative border. A phrase of the border
that turns out common is a failure: the proposal lacked it, and longer phrases that hold it
have not been counted. Failures join the proposal, and a further pass
counts just what this admits, until no failure is left. A common phrase has
common parts, so then every common phrase is counted, and each was counted in one pass over
all documents. The sample only decides how many passes there are.

What is proposed goes to the tasks as Bloom filters of bounded size. One that says yes
wrongly admits a phrase that need not be counted; its count is exact like any other,
so results do not depend on the filters. Phrases themselves are compared as text.

Null texts count as empty and have no words; a null lang is "und"; repeated rows
count each; doc_id only draws the sample and may be null or repeat; other columns play no
part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import written
from corpusloom.llm.words import LOWER, mix, slices, tidy, trimmed

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
BETWEEN = BREAKS.copy()
BETWEEN[[9, 32]] = True
FLUSH = 6_000_000  # bytes of text whose phrases are added up in a task before they go on
ROWS = 50_000  # of a batch
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    least: int = 10  # occurrences of a candidate
    longest: int = 3  # words of a candidate
    redundant: int = 50  # of 100: a longer candidate with this share of the occurrences makes a phrase redundant
    top: int = 2000  # phrases reported of each language
    sample_mb: float = 16.0  # of the plan's estimated size, expected in the sample
    lowered: float = 0.5  # of the sample's share of the threshold
    filter_bits: int = 1 << 27  # of a Bloom filter, at most
    parts: int = 32  # of a language whose best are found side by side


# ---- sets of phrases


@dataclass(frozen=True)
class Bloom:
    """Bits (a power of two) that say of 64-bit hashes whether they may be in a set."""

    bits: np.ndarray  # as 64-bit integers
    PROBES = 4

    @staticmethod
    def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = mix(h) | np.uint64(1)
            for _ in range(Bloom.PROBES):
                yield h & np.uint64(bits - 1)
                h = h + step

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, 64 * len(self.bits)):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Members:
    """Proposed phrases by their number of words: unions of filters."""

    filters: dict[int, tuple[Bloom, ...]] = field(default_factory=dict)

    def hold(self, size: int, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for f in self.filters.get(size, ()):
            found |= f.holds(h)
        return found

    def with_filter(self, size: int, f: Bloom) -> Members:
        return Members(self.filters | {size: (*self.filters.get(size, ()), f)})


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(part: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    with np.errstate(over="ignore"):
        return mix(part * _M + word)


def phrase_hashes(lang: np.ndarray, phrases: list[str]) -> np.ndarray:
    """Of phrases of one size and their languages."""
    out = np.zeros(len(phrases), np.uint64)
    for one in set(lang.tolist()):
        at = np.flatnonzero(lang == one)
        split = [phrases[i].encode().split(b" ") for i in at]
        h = np.zeros(0, np.uint64)
        for k, words in enumerate(zip(*split, strict=True)):
            own = word_hashes(one, list(words))
            h = longer(h, own) if k else own
        out[at] = h
    return out


def bloom_of(phrases: DataFrame, rows: int, most_bits: int) -> Bloom:
    """Of phrases (lang, phrase) of one size, of which there are about `rows`."""
    bits = min(most_bits, max(64, 1 << (12 * rows).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            h = phrase_hashes(np.array(batch.column("lang").to_pylist(), object), batch.column("phrase").to_pylist())
            at = np.unique(np.concatenate(list(Bloom.places(h, bits))))
            which, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    # At most bits / 64 rows of two integers, which Config.filter_bits bounds.
    found = phrases.select("lang", "phrase").mapInArrow(tidy(run), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Bloom(out)


# ---- counting


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the place of each word of all texts among them, and whether the next word follows it in the same piece."""
    data = LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~BETWEEN[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = change[::2], change[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    breaks = np.cumsum(BREAKS[data], dtype=np.int32)
    follows = np.zeros(len(start), bool)
    if len(start):
        follows[:-1] = breaks[start[1:]] == breaks[end[:-1] - 1]
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), follows


def counted(lang: str, texts: list[bytes], config: Config, now: Members | None, before: Members | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, phrases, counts) of the texts' phrases whose parts are all in now and not all in before.

    Without now, of all phrases. Without before also of all words, and as size 0 the number of words.
    """
    different, word, follows = words_of(texts)
    if before is None:
        yield 0, pa.array([b""], pa.large_binary()), np.array([len(word)])
        yield 1, different, np.bincount(word, minlength=len(different))
    own = word_hashes(lang, different.to_pylist()) if now else np.zeros(len(different), np.uint64)
    # Of the phrases of each size: where they begin, and what phrase of that size begins there; then the phrases' hashes and texts.
    at, which, h, text = np.arange(len(word)), word, own, different
    known = np.zeros(len(word), bool) if before is None else np.ones(len(word), bool)  # counted by an earlier pass
    for size in range(2, config.longest + 1):
        if now:
            proposed = now.hold(size - 1, h)[which]
            earlier = known & before.hold(size - 1, h)[which] if before else known
        else:
            proposed = earlier = np.ones(len(at), bool)
        # Two parts that begin at neighbouring words make a phrase.
        neighbours = (at[1:] == at[:-1] + 1) & follows[at[:-1]] & proposed[1:] & proposed[:-1] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(neighbours)
        last = word[at[first] + size - 1]
        key = which[first] * len(different) + last
        if before is not None:
            known = earlier[first] & earlier[first + 1]
        else:
            known = np.zeros(len(first), bool)
        at = at[first]
        keys, one, which = np.unique(key, return_index=True, return_inverse=True)
        head, tail = keys // max(1, len(different)), keys % max(1, len(different))
        h = longer(h[head], own[tail])
        text = pc.binary_join_element_wise(text.take(pa.array(head)), different.take(pa.array(tail)), pa.scalar(b" ", pa.large_binary()))
        fresh = ~known[one]  # the same for all occurrences of a phrase
        yield size, text.filter(pa.array(fresh)), np.bincount(which, minlength=len(keys))[fresh]


_GRAM = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def counting(config: Config, now: Members | None, before: Members | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flushed(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in sorted(held.items()):
            for size, phrases, n in counted(lang, texts, config, now, before):
                phrases = phrases.cast(pa.large_string()).cast(pa.string())
                for k in range(0, len(phrases), ROWS):
                    part = phrases[k : k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), size, np.int32)), part, pa.array(n[k : k + ROWS].astype(np.int64))], schema=_GRAM)
        held.clear()
        trimmed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for rows in slices(batches):
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size > FLUSH:
                yield from flushed(held)
                size = 0
        yield from flushed(held)

    return run


def grams(documents: DataFrame, config: Config, now: Members | None, before: Members | None, least: Column) -> DataFrame:
    """(lang, size, phrase, n) of what counting() yields over all documents, where least holds."""
    rows = documents.mapInArrow(tidy(counting(config, now, before)), "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(least)


@dataclass
class Mined:
    """counts: (lang, size, phrase, n) of all phrases with config.least occurrences, and with size 0 each language's words; passes over all documents; failures of each pass."""

    counts: DataFrame
    passes: int
    failures: list[int]


def mine(documents: DataFrame, config: Config = Config()) -> Mined:
    docs = documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    share = min(1.0, config.sample_mb * 2**20 / max(1, size))
    drawn = docs.where((F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))) < share)
    texts = docs.select("lang", "text")
    least = max(2, int(config.lowered * config.least * share))
    proposed = written(grams(drawn.select("lang", "text"), config, None, None, F.col("size").between(1, config.longest - 1) & (F.col("n") >= least)), "phrases-proposed")
    enough = (F.col("size") == 0) | (F.col("n") >= config.least)

    def extended(members: Members, phrases: DataFrame) -> tuple[Members, int]:
        """With the phrases that it lacks, and how many those were. A filter that holds a phrase already needs no second one for it."""

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("size").to_numpy(zero_copy_only=False)
                new = np.zeros(len(kinds), bool)
                langs, names = np.array(batch.column("lang").to_pylist(), object), batch.column("phrase").to_pylist()
                for k in set(kinds.tolist()):
                    own = np.flatnonzero(kinds == k)
                    new[own] = ~members.hold(k, phrase_hashes(langs[own], [names[i] for i in own]))
                yield batch.filter(pa.array(new))

        new = written(phrases.mapInArrow(tidy(lacking), "lang string, size int, phrase string, n long"), "phrases-admitted")
        rows = {r["size"]: r.n for r in new.groupBy("size").agg(F.count("*").alias("n")).collect()}
        for k, n in sorted(rows.items()):
            members = members.with_filter(k, bloom_of(new.where(F.col("size") == k), n, config.filter_bits))
        return members, sum(rows.values())

    members, _ = extended(Members(), proposed)
    tables, failures, before = [], [], None
    while True:
        tables.append(written(grams(texts, config, members, before, enough), "phrases-counted"))
        before = members
        members, failed = extended(members, tables[-1].where(F.col("size").between(1, config.longest - 1)))
        failures.append(failed)
        if not failed:
            break
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.unionByName(t)
    return Mined(counts, len(tables), failures)


# ---- scores


def scored(counts: DataFrame, config: Config = Config()) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate makes redundant.

    The score is floor(1000000 * a * a / (l * r)) at the cut into two parts where it is least, the first
    of equal ones. Products are decimals of 38 digits.
    """
    plain = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    covers = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), b -> array_join(slice(split(phrase, ' ', -1), b, s), ' '))))")).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < config.redundant * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", words.alias("words"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail")
    )
    heads, tails = (plain.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)) for part, name in (("head", "l"), ("tail", "r")))
    exact = F.expr("cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * cast(1000000 as decimal(7, 0)) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    whole = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", exact)
    least = whole.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """Each language's first config.top, with their rank. A language's best are found in parts, and the best of these then."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(config.parts))
    first = scores.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= config.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= config.top).select("lang", "rank", "phrase", "a", "l", "r", "score")


def collocations(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score). The languages' numbers of words join what is reported, a bounded number of rows for each."""
    counts = mine(documents, config).counts
    totals = counts.where("size = 0").select("lang", "n")
    return ranked(scored(counts, config), config).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same for three words at most, in DuckDB's SQL; documents is a view.
SQL = r"""
with piece as (
  select row_number() over () as id, lang, p from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), listed as (
  select id, lang, regexp_extract_all(p, '[^ \t]+') as ws from piece
), word as (
  select lang, unnest(ws) as w, id, generate_subscripts(ws, 1) as i from listed
), follow as (
  select lang, w, lead(w) over one as w2, lead(w, 2) over one as w3 from word window one as (partition by id order by i)
), f as (
  select lang, 1 as size, w as phrase, count(*) as n from follow group by all
  union all select lang, 2, w || ' ' || w2, count(*) from follow where w2 is not null group by all
  union all select lang, 3, w || ' ' || w2 || ' ' || w3, count(*) from follow where w3 is not null group by all
), total as (select lang, sum(n)::bigint as n from f where size = 1 group by lang),
candidate as (select lang, size, phrase, n as a, string_split(phrase, ' ') as ws from f where size > 1 and n >= 10),
covered as (
  select lang, part, max(a) as longer from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from candidate where size = 3) group by all
), kept as (
  select c.* from candidate c left join covered v on c.lang = v.lang and c.phrase = v.part where v.longer is null or 100 * v.longer < 50 * c.a
), cut as (
  select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail from (select *, unnest(range(1, size)) as k from kept)
), scored as (
  select c.lang, c.phrase, c.a, c.k, h.n as l, t.n as r, ((1000000::hugeint * c.a * c.a) // (h.n::hugeint * t.n))::bigint as score
  from cut c join f h on c.lang = h.lang and c.head = h.phrase join f t on c.lang = t.lang and c.tail = t.phrase
), least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, s.l, s.r, t.n, s.score
from least s join total t on s.lang = t.lang
qualify rank <= 2000
"""
