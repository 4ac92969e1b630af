"""A text index in files: for each word the documents that hold it and the places it has there.

build() cuts every text into words once and writes postings (bucket, term, keys, n,
places), frequencies of terms, and the documents' keys with the columns that searches filter by. Postings
are laid out by buckets of terms and sorted by term, so a question reads the row groups of its terms
and no text; large buckets, as of a word that most documents hold, are split over several files.

A question (the trees of operators.fulltext) is answered from its terms' postings:
they are brought together by document, phrases and what is left out are decided by places, and
ranks take the places too. Where the rarest word that every match holds is rare enough to be
broadcast, the other words' postings are cut to its documents before they are shuffled.

Keys must tell documents apart. Null and empty texts have no words: only a question that
asks for none finds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.english import STOP_WORDS, stem
from corpusloom.functions.text import tokens
from corpusloom.operators import fulltext
from corpusloom.operators import stored as tables
from corpusloom.operators.fulltext import Node

BUCKETS = 64
RARE = 20_000  # documents of a word that are broadcast, at most


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    path: str
    keys: tuple[str, ...]
    config: str  # of operators.fulltext: simple or english

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(term, *keys, n, places) of some terms."""
        wanted = spark.range(1).select(F.array(*[_bucket(F.lit(t)) for t in terms]).alias("b")).first().b if terms else []
        # Stated, as an index of no words has no file that could tell it.
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.documents(spark).select(*self.keys).schema)
        rows = spark.read.schema(f"term string, {keys}, n int, places array<int>, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin([int(b) for b in set(wanted)]) & F.col("term").isin(terms)).drop("bucket")

    def documents(self, spark: SparkSession) -> DataFrame:
        """(*keys, *columns) of every document."""
        return spark.read.parquet(f"{self.path}/documents")

    def frequencies(self, spark: SparkSession, terms: list[str]) -> dict[str, int]:
        """In how many documents each of a question's terms occurs; a row a term."""
        found = spark.read.parquet(f"{self.path}/frequencies").where(F.col("term").isin(terms)).select("term", "docs")
        return dict.fromkeys(terms, 0) | {r.term: r.docs for r in found.collect()}


def build(texts: DataFrame, path: str, keys: tuple[str, ...], text: Column, columns: tuple[str, ...] = (), config: str = "simple") -> TextIndex:
    """Write the index of texts at path, over what is there."""
    cut = texts.select(*keys, tokens(text).alias("words"))
    fields = [f for f in cut.schema if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            flat = pc.list_flatten(words)
            if not len(flat):
                continue
            row = pc.list_parent_indices(words).to_numpy()
            first = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
            coded = flat.dictionary_encode()
            names = coded.dictionary.to_pylist()
            if config == "english":
                names = [None if w in STOP_WORDS else stem(w) for w in names]
            # Different words may have one stem.
            known = {n: i for i, n in enumerate(dict.fromkeys(n for n in names if n))}
            term = np.array([known.get(n, -1) for n in names])[coded.indices.to_numpy()]
            kept = np.flatnonzero(term >= 0)
            order = kept[np.lexsort((place[kept], term[kept], row[kept]))]
            if not len(order):
                continue
            new = np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(term[order], prepend=-1) != 0))
            ends = np.append(new, len(order))
            at = order[new]
            columns_ = [batch.column(f.name).take(pa.array(row[at])) for f in fields]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(term[at])), *columns_, pa.array(np.diff(ends).astype(np.int32)), lists], ["term", *(f.name for f in fields), "n", "places"])

    schema = "term string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n int, places array<int>"
    rows = cut.mapInArrow(run, schema).withColumn("bucket", _bucket(F.col("term")))
    # Rebalanced, not repartitioned: a bucket that a frequent word swells is split into files of the usual size.
    # A worker holds a batch's words several times over, so batches are small.
    with tables.small_batches(texts.sparkSession):
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = TextIndex(path, keys, config)
    spark = texts.sparkSession
    stored = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
    texts.select(*keys, *columns).write.mode("overwrite").parquet(f"{path}/documents")
    return index


def stored(texts: DataFrame, keys: tuple[str, ...], text: Column, columns: tuple[str, ...] = (), config: str = "simple") -> TextIndex:
    """The index of texts read from files, kept in the session's shared folder and made when there is none of these very files, text and columns yet."""
    return TextIndex(tables.stored(texts, (keys, text, columns, config), lambda path: build(texts, path, keys, text, columns, config), "texts"), keys, config)


# ---- answers


def words_of(node: Node) -> list[str]:
    """All different words of a tree, negated ones too."""
    own = list(node.words) + [w for p in node.parts for w in words_of(p)]
    return list(dict.fromkeys(own))


def _less(i: int) -> Callable[[Column], Column]:
    return lambda p: p - i


def fits(at: Callable[[str], Column], node: Node) -> Column:
    """Whether a document with these places (null or none where a word is missing) fits the tree."""
    if node.op == "term":
        return F.coalesce(F.size(at(node.words[0])) > 0, F.lit(False))
    if node.op == "phrase":
        row = at(node.words[0])
        for i, w in enumerate(node.words[1:], 1):
            row = F.array_intersect(row, F.transform(at(w), _less(i)))
        return F.coalesce(F.size(row) > 0, F.lit(False))
    if node.op == "not":
        return ~fits(at, node.parts[0])
    out = fits(at, node.parts[0])
    for p in node.parts[1:]:
        out = out & fits(at, p) if node.op == "and" else out | fits(at, p)
    return out


def without_words(node: Node) -> bool:
    """Whether a document that holds no word of the tree fits it."""
    if node.op == "not":
        return not without_words(node.parts[0])
    return {"and": all, "or": any}.get(node.op, lambda _: False)(without_words(p) for p in node.parts)


@dataclass(frozen=True)
class Found:
    """rows: (*keys, *columns) of what fits, with a column of places for each word of the question."""

    rows: DataFrame
    names: dict[str, str]

    def at(self, term: str) -> Column:
        """Places of a word; none where it does not occur."""
        return F.coalesce(F.col(self.names[term]), F.array().cast("array<int>"))


def search(index: TextIndex, spark: SparkSession, question: str | Node, also: tuple[str, ...] = (), where: Column | None = None, columns: tuple[str, ...] = ()) -> Found:
    """What fits the question, with the index's `columns`, among documents for which `where` holds; places also of the words `also`."""
    node = fulltext.parsed(question, index.config) if isinstance(question, str) else question
    terms = list(dict.fromkeys([*(words_of(node) if node else []), *also]))
    names = {t: f"_places_{i}" for i, t in enumerate(terms)}
    rows = index.postings(spark, terms)
    keys = list(index.keys)
    needed = fulltext.needed(node) if node else []
    if len(terms) > 1 and needed:
        often = index.frequencies(spark, needed)
        rarest = min(needed, key=often.__getitem__)
        if often[rarest] <= RARE:
            rows = rows.join(F.broadcast(rows.where(F.col("term") == rarest).select(keys)), keys, "left_semi")
    by_doc = rows.groupBy(keys).agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(n) for t, n in names.items()]) if terms else index.documents(spark).select(keys).limit(0)
    if node is None:
        by_doc = by_doc.where(F.lit(False))
    documents = index.documents(spark)
    if node and without_words(node):
        by_doc = (documents if where is None else documents.where(where)).select(*keys, *columns).join(by_doc, keys, "left")
    elif where is not None or columns:
        by_doc = by_doc.join((documents if where is None else documents.where(where)).select(*keys, *columns), keys)
    found = Found(by_doc, names)
    return Found(by_doc.where(fits(found.at, node)), names) if node else found


def rank(found: Found, node: Node) -> Column:
    return fulltext.rank_at(found.at, node)


def cover_rank(found: Found, node: Node) -> Column:
    return fulltext.cover_rank_at(found.at, node)


def frequency_rank(found: Found, terms: list[str]) -> Column:
    """Sum over terms of tf / (tf + 1)."""
    tf = [F.size(found.at(t)).cast("double") for t in terms]
    return sum((t / (t + 1) for t in tf), F.lit(0.0))
