"""Vector search, full-text search, fusion and selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.relational import best_of


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query vector, in double precision; null if the lengths differ or a side is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in map(float, query)) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * F.lit(size)
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows, exactly: filters come before the scores, ties go to the smaller id."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("score", cosine(F.col("embedding"), query)).where(F.col("score").isNotNull()).orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_per(vectors: DataFrame, query: list[float], group: str, k: int) -> DataFrame:
    scored = vectors.withColumn("score", cosine(F.col("embedding"), query)).where(F.col("score").isNotNull())
    return best_of(scored, [group], [F.desc("score"), F.asc("vec_id")], k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, parts: int | None = None) -> DataFrame:
    """(qid, vec_id, score): the k nearest vectors of each query (both vec_id, embedding), itself left out; ties go to the smaller id.

    Vectors and queries are dealt into blocks and every two blocks meet in one task, which
    keeps k rows a query; the best of those are chosen by query. The queries are a stated
    set, so their blocks are few; no task grows with either table.
    """
    spark = vectors.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-queries.count() // block))
    spread = lambda df, own, count, other, others: df.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))
    both = spread(vectors, "v", parts, "q", n).withColumn("asks", F.lit(False)).unionByName(spread(queries, "q", n, "v", parts).withColumn("asks", F.lit(True)))
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows["embedding"]))
        sizes = pc.list_value_length(rows["embedding"]).to_numpy()
        asks, ids = rows["asks"].to_numpy(zero_copy_only=False), rows["vec_id"].to_numpy()
        out = []
        for size in set(sizes[asks].tolist()) & set(sizes[~asks].tolist()):
            own = np.flatnonzero(sizes == size)
            x = pc.list_flatten(rows["embedding"].take(pa.array(own))).cast(pa.float64()).to_numpy().reshape(len(own), size)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            a, v = asks[own], ids[own]
            scores = x[a] @ x[~a].T
            for i, qid in enumerate(v[a]):
                s = np.where(v[~a] == qid, -2.0, scores[i])
                # Scores that differ by rounding only count as equal, as elsewhere.
                top = np.lexsort((v[~a], -np.round(s, 12)))[:k]
                out += [(int(qid), int(v[~a][j]), float(s[j])) for j in top if s[j] > -2]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    found = both.groupBy("v", "q").applyInArrow(best, "qid long, vec_id long, score double")
    return best_of(found, ["qid"], [F.desc(F.round("score", 12)), F.asc("vec_id")], k)


def centroids(vectors: DataFrame, group: str, spread: int = 64) -> DataFrame:
    """(group, dim, mean): the mean vector of each group, one row a dimension; null vectors and those of another length than the group's most frequent (of equals the shorter) have no part.

    Vectors are summed where they are, as arrays: a task makes one row for each group and length, and the rows of a group are added up in two steps.
    """
    kind = vectors.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, part int, size int, n long, total array<double>"
    names = [group, "part", "size", "n", "total"]

    def summed(keys: pa.Array, sizes: np.ndarray, counts: np.ndarray, lists: pa.Array, part: int) -> list[pa.RecordBatch]:
        coded = keys.dictionary_encode(null_encoding="encode")
        which = coded.indices.to_numpy()
        out = []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = pc.list_flatten(lists.take(pa.array(own))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), size)
            at, of = np.unique(which[own], return_inverse=True)
            total = np.zeros((len(at), size))
            np.add.at(total, of, x)
            n = np.bincount(of, counts[own], len(at)).astype(np.int64)
            out.append(pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at)), pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names))
        return out

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("embedding")), pc.greater(pc.fill_null(pc.list_value_length(batch.column("embedding")), 0), 0)))
            if len(batch):
                sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
                part = int(batch.column("part")[0].as_py()) % spread
                yield from summed(batch.column(group), sizes, np.ones(len(batch)), batch.column("embedding"), part)

    def again(last: bool) -> Callable[[pa.Table], pa.Table]:
        def add(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            column = lambda c: rows[c].combine_chunks()
            parts = summed(column(group), column("size").to_numpy(), column("n").to_numpy(), column("total"), int(rows["part"][0].as_py()))
            whole = pa.Table.from_batches(parts)
            if not last:
                return whole
            sizes, n = whole["size"].to_pylist(), whole["n"].to_pylist()
            best = min(range(len(n)), key=lambda i: (-n[i], sizes[i]))
            mean = np.array(whole["total"][best].as_py()) / n[best]
            return pa.Table.from_arrays([pa.concat_arrays([whole[group].combine_chunks().take(pa.array([best] * len(mean)))]), pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(mean)], [group, "dim", "mean"])

        return add

    first = vectors.select(group, "embedding", F.spark_partition_id().alias("part")).mapInArrow(within, schema)
    second = first.groupBy(group, "part").applyInArrow(again(False), schema)
    return second.groupBy(group).applyInArrow(again(True), f"`{group}` {kind}, dim int, mean double")


def matches(docs: DataFrame, words: list[str], phrase: list[str] = (), without: list[str] = ()) -> DataFrame:
    """docs that hold every word, the phrase, and none of `without`; words are runs of a-z and 0-9. Adds column words."""
    w = docs.withColumn("words", tokens(F.col("text")))
    for term in words:
        w = w.where(F.array_contains("words", term))
    for term in without:
        w = w.where(~F.array_contains("words", term))
    if phrase:
        w = w.where(F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " ")))
    return w


def frequency_rank(words: Column, terms: list[str]) -> Column:
    """Sum over terms of tf / (tf + 1)."""
    count = lambda term: F.size(F.filter(words, lambda w: w == term)).cast("double")
    tf = [count(t) for t in terms]
    return sum((t / (t + 1) for t in tf), F.lit(0.0))


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """A short candidate list with `rank` from 1; its k rows are sorted in one task, so limit it first."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def reciprocal_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): sum of 1 / (k + rank) over ranked lists."""
    every = lists[0].select(key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def linear_fusion(text: DataFrame, vector: DataFrame, key: str, text_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """(key, score): weighted scores of both lists, 0 where a list lacks the row."""
    a, b = text.select(key, F.col("score").alias("t")), vector.select(key, F.col("score").alias("v"))
    return a.join(b, key, "full").select(key, (text_weight * F.coalesce("t", F.lit(0.0)) + vector_weight * F.coalesce("v", F.lit(0.0))).alias("score"))


def select_diverse(ranked_: DataFrame, group: str, k: int, cap: int = 2, free: Column | None = None) -> DataFrame:
    """k rows in order of rank with at most cap of a group (rows where `free` holds don't count as over); later ones fill up what is missing."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
    late = nth > cap if free is None else (nth > cap) & ~free
    return ranked_.withColumn("deferred", late).orderBy("deferred", "rank").limit(k)


def promoted(ranked_: DataFrame, on: Column, most: int = 2) -> DataFrame:
    """`place` from 1: up to `most` rows for which `on` holds come first, all else keeps its order."""
    nth = F.sum(on.cast("int")).over(Window.orderBy("rank"))
    return ranked_.withColumn("_front", on & (nth <= most)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("_front"), "rank"))).drop("_front")
