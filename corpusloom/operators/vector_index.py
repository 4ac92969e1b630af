"""An index of vectors in files: inverted lists with residual codes, for approximate and for exact search by cosine.

A k-means on a bounded sample gives the lists' centres. Each vector, taken to length
1, goes to the list of the nearest centre and is stored with 8-bit codes of what it
differs from that by, and with the columns that searches filter by. Files are laid out
by list, so a search reads the lists that it probes, and of those the codes; only the short
list that the codes leave is scored by the vectors themselves, in double precision.

A query probes the lists of the nearest centres, as many as the sample needed for the recall that is asked for. Where fewer than k rows pass its filter there,
the next lists follow, twice as many each time, until it has its k rows or no list is left.
An exact search goes on until the lists that are left can hold nothing nearer: a list's
vectors lie within its radius of the centre, which bounds their cosines. Codes leave out
only what is certainly not among the k nearest, by the bound on what rounding took from them.

Vectors that are null, zero, of another length than most or not finite are in no list. Ties
go to the smaller id. A query never finds the row of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.fixpoint import kept
from corpusloom.operators.relational import best_of

_EPS = 1e-9  # what sums in double precision may be off by


@dataclass(frozen=True)
class Config:
    lists: int | None = None  # None: the root of the number of vectors, within the next two
    least_lists: int = 4
    most_lists: int = 4096
    sample_rows: int = 20_000  # that centres are fitted to
    sample_mb: float = 16.0  # of them
    steps: int = 10
    file_rows: int = 200_000  # of a list that one file holds, about
    recall: float = 0.95  # of the ten nearest, that probes of an approximate search are set for
    recall_queries: int = 200  # of the sample, that it is measured with
    seed: int = 5


def _usable(size: int | None = None) -> Column:
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return fine if size is None else fine & (F.size(v) == size)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    x = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, lists: int, steps: int, seed: int) -> np.ndarray:
    """Spherical k-means: rows of length 1. A centre that loses all rows goes to the row that is worst served."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[rng.permutation(len(different))[:lists]]
    for _ in range(steps):
        dot = x @ centres.T
        own = dot.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        lost = np.flatnonzero(size[:, 0] < 1e-12)
        centres = np.where(size < 1e-12, centres, sums / np.maximum(size, 1e-300))
        if len(lost):
            centres[lost] = x[np.argsort(dot.max(1), kind="stable")[: len(lost)]]
    return centres


def encoded(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """List, cosine with its centre, scale, and codes of rows of length 1; of equally near centres the first."""
    dot = x @ centres.T
    own = dot.argmax(1)
    rest = x - centres[own]
    scale = np.abs(rest).max(1)
    codes = np.round(rest / np.maximum(scale, 1e-300)[:, None] * 127).astype(np.int8)
    return own, dot[np.arange(len(x)), own], scale, codes


def probes_for(x: np.ndarray, centres: np.ndarray, config: Config) -> int:
    """The least number of lists in which rows of a sample find config.recall of their ten nearest in it."""
    few = x[: config.recall_queries]
    dot = few @ x.T
    dot[np.arange(len(few)), np.arange(len(few))] = -2
    k = min(10, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-dot, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(few @ centres.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(1)[near], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(config.recall * len(at))) - 1)]) + 1


@dataclass(frozen=True)
class Index:
    """path/lists holds (list, part, vec_id, embedding, dot, scale, code, same, *columns), path/centres a row a list."""

    path: str
    size: int
    centres: np.ndarray
    radius: np.ndarray  # the greatest angle of a list's vectors with its centre
    rows: np.ndarray
    probes: int  # lists that an approximate search begins with

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Index:
        rows = sorted(spark.read.parquet(f"{path}/centres").collect())  # Config.most_lists at most
        if not rows:
            return cls(path, 0, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), 1)
        centres = np.array([r.centre for r in rows])
        return cls(path, centres.shape[1], centres, np.array([r.radius for r in rows]), np.array([r.n for r in rows]), rows[0].probes)


def build(vectors: DataFrame, path: str, columns: tuple[str, ...] = (), config: Config = Config()) -> Index:
    """Write the index of vectors (vec_id, embedding, *columns) at path, over what is there, and open it."""
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "embedding", *columns).where(_usable())
    sizes = own.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size, count = (sizes["size"], sizes.n) if sizes else (1, 0)
    own = own.where(F.size("embedding") == size)
    few = int(min(config.sample_rows, max(1, config.sample_mb * 2**20 // (8 * size))))
    drawn = own.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(1 << 53)) < min(1.0, 4 * few / max(1, count)))
    sample = drawn.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).toArrow()
    lists = config.lists or int(min(config.most_lists, max(config.least_lists, round(count**0.5))))
    x = _matrix(sample["embedding"].combine_chunks(), size) if len(sample) else np.zeros((0, size))
    centres = fit_centres(x, lists, config.steps, config.seed) if len(x) else x
    probes = probes_for(x, centres, config)
    kinds = [(f.name, f.dataType.simpleString()) for f in own.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                of, dot, scale, codes = encoded(_matrix(batch.column("embedding"), size), centres)
                added = [pa.array(of.astype(np.int32)), pa.array(dot), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "list", "dot", "scale", "code"])

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds) + ", list int, dot double, scale double, code binary"
    # Equal vectors are told by a hash, so that thousands of copies need not all be scored.
    coded = own.mapInArrow(run, schema).withColumn("same", F.xxhash64("embedding"))
    # A list of any size is written as files of about file_rows, by the share of all rows that a task's hash gets.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // config.file_rows)))).cast("int")
    coded.withColumn("part", part).repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    figures = {r["list"]: r for r in spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.min("dot").alias("dot"), F.count("*").alias("n")).collect()} if count else {}
    rows = [(i, c.tolist(), float(np.arccos(np.clip(figures[i].dot, -1, 1))) if i in figures else 0.0, figures[i].n if i in figures else 0, probes) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "list int, centre array<double>, radius double, n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Index.opened(spark, path)


def _ordered(index: Index, queries: DataFrame, exact: bool) -> DataFrame:
    """(qid, q, lists, bounds): each usable query at length 1 with all lists that have rows, in the order in which it probes them, and what each can hold at best."""
    some = np.flatnonzero(index.rows > 0)
    centres, radius = index.centres[some], index.radius[some]
    schema = pa.schema([("qid", pa.int64()), ("q", pa.list_(pa.float64())), ("lists", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("embedding"), index.size)
            dot = np.clip(q @ centres.T, -1, 1)
            bound = np.cos(np.maximum(0, np.arccos(dot) - radius)) + 1e-7
            order = np.argsort(-(bound if exact else dot), axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(list(q), pa.list_(pa.float64())), pa.array(list(some[order].astype(np.int32)), pa.list_(pa.int32())), pa.array(list(np.take_along_axis(bound, order, 1)), pa.list_(pa.float64()))], schema=schema)

    return queries.select("vec_id", "embedding").where(_usable(index.size)).mapInArrow(run, "qid long, q array<double>, lists array<int>, bounds array<double>")


def _short_lists(index: Index, rows: DataFrame, probes: DataFrame, k: int, chunks: int, block: int) -> DataFrame:
    """(qid, list, vec_id) of rows that the codes leave for probes (qid, q, list). Rows of a list are dealt into chunks and its queries into blocks, and each two meet in one task."""
    size, centres = index.size, index.centres
    n = probes.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(n), "list").select("list", "vec_id", "scale", "code", "same", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = probes.join(F.broadcast(n), "list").select("list", F.col("qid").alias("vec_id"), "q", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    both = dealt.withColumn("q", F.lit(None).cast("array<double>")).unionByName(asked.withColumns({"scale": F.lit(None).cast("double"), "code": F.lit(None).cast("binary"), "same": F.lit(None).cast("long")}))
    schema = pa.schema([("qid", pa.int64()), ("list", pa.int32()), ("vec_id", pa.int64())])

    def pick(table: pa.Table) -> pa.Table:
        asks, own = table.filter(pc.is_valid(table["q"])), table.filter(pc.is_null(table["q"]))
        if not len(asks) or not len(own):
            return schema.empty_table()
        which = int(own["list"][0].as_py())
        own = own.sort_by("vec_id")
        ids, scale, same = (own[c].to_numpy() for c in ("vec_id", "scale", "same"))
        codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.int8).reshape(len(ids), size)
        x = centres[which] + codes * (scale / 127)[:, None]
        off = scale * (size**0.5 / 254) + _EPS
        # Of copies only the first k + 1 can matter (one of them may be the query).
        order = np.lexsort((ids, same))
        first = np.ones(len(ids), bool)
        first[1:] = same[order][1:] != same[order][:-1]
        nth = np.arange(len(ids)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = np.sort(order[nth <= k])
        ids, x, off = ids[keep], x[keep], off[keep]
        q = np.array(asks["q"].to_pylist())
        found_q, found_v = [], []
        for qid, s in zip(asks["vec_id"].to_pylist(), q @ x.T, strict=True):
            fit = np.flatnonzero(ids != qid)
            low = (s - off)[fit]
            enough = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            own_ids = ids[fit[(s + off)[fit] >= enough]]
            found_q.append(np.full(len(own_ids), qid))
            found_v.append(own_ids)
        v = np.concatenate(found_v)
        return pa.Table.from_arrays([pa.array(np.concatenate(found_q).astype(np.int64)), pa.array(np.full(len(v), which, np.int32)), pa.array(v.astype(np.int64))], schema=schema)

    return both.groupBy("list", "chunk", "block").applyInArrow(pick, "qid long, list int, vec_id long")


def _scored(index: Index, found: DataFrame, probes: DataFrame, lists: DataFrame) -> DataFrame:
    """(qid, vec_id, score) of a short list, by the vectors themselves."""
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    size = index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = np.array(batch.column("q").to_pylist())
                s = np.einsum("ij,ij->i", q, _matrix(batch.column("embedding"), size))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vec_id"), pa.array(s)], schema=schema)

    # Merged, not broadcast: vectors would pass through the driver in every round.
    rows = found.join(lists.select("list", "vec_id", "embedding").hint("merge"), ["list", "vec_id"]).join(probes.select("qid", "q").distinct().hint("merge"), "qid")
    return rows.select("qid", "vec_id", "q", "embedding").mapInArrow(run, "qid long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, exact: bool = False, block: int = 1024, chunk_rows: int = 100_000) -> DataFrame:
    """(qid, vec_id, score): k rows that pass the filter for each query (vec_id, embedding), by cosine.

    Not exact: the nearest found in the lists of the nearest centres, `probes` or as many as the index was
    found to need, and in further ones while k rows are lacking. Exact: the nearest of all. Ties are by the score to 12 places.
    """
    spark = queries.sparkSession
    if not index.size or not index.rows.sum():
        return spark.createDataFrame([], "qid long, vec_id long, score double")
    waiting = kept(_ordered(index, queries, exact))
    some, begin, end, best = int((index.rows > 0).sum()), 0, probes or (8 if exact else index.probes), None
    order = [F.desc(F.round("score", 12)), F.asc("vec_id")]
    every = index.lists(spark)  # opened once: each time lists all files to the driver
    while True:
        asked = waiting.select("qid", "q", F.explode(F.slice("lists", begin + 1, end - begin)).alias("list"))
        # The lists that are probed are known before the scan, so that only their files are read.
        probed = [r["list"] for r in asked.select("list").distinct().collect()]
        lists = every.where(F.col("list").isin(probed))
        rows = lists if where is None else lists.where(where)
        chunks = max(1, -(-int(index.rows[probed].max(initial=1)) // chunk_rows))
        fresh = _scored(index, _short_lists(index, rows, asked, k, chunks, block), asked, lists)
        best = kept(best_of(fresh if best is None else best.unionByName(fresh), ["qid"], order, k))
        begin, end = end, 2 * end
        if begin >= some:
            return best
        have = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        lacking = F.coalesce("n", F.lit(0)) < k
        if exact:
            # Lists are in the order of what they can hold at best, so the next one's bound is that of all that are left.
            lacking = lacking | (F.get("bounds", F.lit(begin)) >= F.col("worst"))
        waiting = kept(waiting.join(have, "qid", "left").where(lacking).drop("n", "worst"))
        if waiting.isEmpty():
            return best
