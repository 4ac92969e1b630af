"""Embedding near-dedup: an exact range join of unit vectors over pivot cells.

Cosine at least c means a distance of at most r = sqrt(2 - 2c) between unit
vectors. Pivots from a bounded sample, each far from the others, divide the
vectors into cells, one for each vector: that of its nearest pivot. A vector also
visits another cell q where a partner could be at home: the triangle inequality
asks d(x, q) <= d(x, home) + 2 r and d(x, q) <= radius(q) + r, and the bisecting
plane between the pivots at most r away. Of two cells only one sends visitors to the
other, so each pair meets once. Cells join independently. A cell with many
vectors is dealt out in blocks, so no task grows with a cell, and a block emits
counts and a forest of links, never its pairs.

Within a block a second filter comes before the product: the vectors' parts in a
few orthogonal directions, the sample's principal ones, and the length of the rest
bound a cosine from above. Only pairs that the bound leaves are multiplied out.

Equal vectors are joined as one with their number. Vectors are joined with those
of their own length. Vectors that are null, zero, or hold null or non-finite
components, and rows without vec_id, link with nothing: n_links 0, kept. Rows that repeat a vec_id count as vectors of their
own. Pairs within 1e-9 of the bound are decided by exactly rounded sums. Other
columns of the input play no part.

How many cells a vector visits is up to the data: where vectors point evenly in all
of many directions, no pivot is near any, and nearly all cells are visited. The work is
then that of all pairs, which no exact metric method avoids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components, forest
from corpusloom.llm.shared import written

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class Config:
    cosine: float = 0.9
    sample: int = 4096  # vectors of a length that pivots and directions are chosen from
    cell: int = 8192  # vectors a pivot, about
    most_pivots: int = 1024  # cells beyond are larger, and dealt out in more blocks
    natives: int = 8192  # of a cell in one block
    members: int = 16384
    directions: int = 20


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding, size) whose vectors can be compared."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    return vectors.select("vec_id", "embedding", F.size("embedding").alias("size")).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind)))
        & F.exists("embedding", lambda x: x != 0)
    )


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample: the first, then each the farthest from those before it."""
    u = unit(sample)
    chosen, far = [0], np.full(len(u), np.inf)
    while len(chosen) < min(count, len(u)):
        far = np.minimum(far, 2 - 2 * u @ u[chosen[-1]])
        chosen.append(int(far.argmax()))
    return u[chosen]


def directions_of(sample: np.ndarray, count: int) -> np.ndarray:
    """(component, direction): the sample's principal directions, orthogonal and of length 1."""
    u = unit(sample)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :count]


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))


def visits(d: np.ndarray, apart: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """(vector, cell): whether the vector is at home in the cell or may have partners there that don't visit its own."""
    home = d.argmin(1)
    own = d.min(1)[:, None]
    slack = 1e-6
    plane = d**2 - own**2 <= 2 * apart[home] * (r + slack) + slack
    out = (d <= own + 2 * r + slack) & (d <= radius[None] + r + slack) & plane
    # Of two cells the lower sends visitors to the higher if their numbers' sum is even, else the higher to the lower.
    cell = np.arange(d.shape[1])
    out &= ((home[:, None] + cell) % 2 == 0) == (cell > home[:, None])
    out[np.arange(len(d)), home] = True
    return out


def _bounds(u: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """For each unit vector its parts in the directions and the length of the rest: their product bounds the cosine."""
    parts = u @ directions
    rest = np.sqrt(np.maximum(0, 1 - (parts**2).sum(1)))
    return np.column_stack([parts, rest]).astype(np.float32)


def joined_block(y: np.ndarray, x: np.ndarray, ids_y: np.ndarray, ids_x: np.ndarray, both_home: np.ndarray, times_y: np.ndarray, times_x: np.ndarray, directions: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each row of y and of x the number of vectors it is newly linked with, and a forest of the links.

    both_home: the members x that are at home with y; of such pairs, which meet twice, the one with the lower id in y counts.
    """
    uy, ux = unit(y), unit(x)
    by, bx = _bounds(uy, directions), _bounds(ux, directions)
    count_y, count_x, links = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for begin in range(0, len(y), 256):
        part = slice(begin, begin + 256)
        near = by[part] @ bx.T >= cosine - 1e-5  # beyond the rounding of such short products
        i, j = np.nonzero(near)
        if len(i) > 0.02 * near.size:
            dots = (uy[part] @ ux.T)[i, j]
        else:
            dots = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", uy[begin + i[k : k + 65536]], ux[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
        hit = dots >= cosine
        for k in np.flatnonzero(np.abs(dots - cosine) < 1e-9):
            hit[k] = exact_cosine(y[begin + i[k]], x[j[k]]) >= cosine
        i, j = i[hit] + begin, j[hit]
        once = (ids_y[i] < ids_x[j]) | ~both_home[j]
        i, j = i[once], j[once]
        if len(i):
            count_y += np.bincount(i, times_x[j], len(y)).astype(np.int64)
            count_x += np.bincount(j, times_y[i], len(x)).astype(np.int64)
            links = forest(np.concatenate([links[0], ids_y[i]]), np.concatenate([links[1], ids_x[j]]))
    return count_y, count_x, links


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def linked(classes: DataFrame, count: int, config: Config) -> DataFrame:
    """(a, b, n) of different vectors (embedding, rep, times) of one length: n > 0 more vectors that a is linked with, or with n 0 a link in a forest of the links."""
    r = math.sqrt(2 - 2 * config.cosine)
    sample = np.array([list(x.embedding) for x in classes.orderBy(F.xxhash64("rep"), "rep").limit(config.sample).collect()], float)
    pivots, directions = pivots_of(sample, min(config.most_pivots, -(-count // config.cell))), directions_of(sample, config.directions)
    k, apart = len(pivots), distances(pivots, pivots)
    raw = np.dtype("<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows, a few at a time, with their vectors and distances to all pivots."""
        for whole in batches:
            for begin in range(0, len(whole), 1000):
                batch = whole.slice(begin, 1000)
                v = _matrix(batch)
                yield batch, v, distances(unit(v.astype(float)), pivots)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(k, np.int64), np.zeros(k)
        for _, _, d in parts(batches):
            n += np.bincount(d.argmin(1), minlength=k)
            np.maximum.at(radius, d.argmin(1), d.min(1))
        yield pa.RecordBatch.from_pydict({"cell": np.flatnonzero(n), "n": n[n > 0], "radius": radius[n > 0]})

    natives, radius = np.zeros(k, np.int64), np.full(k, -np.inf)
    for row in classes.mapInArrow(at_home, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        natives[row.cell], radius[row.cell] = row.n, row.radius

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k, np.int64)
        for _, _, d in parts(batches):
            n += visits(d, apart, radius, r).sum(0)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k), "n": n})

    members = np.zeros(k, np.int64)
    for row in classes.mapInArrow(visiting, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        members[row.cell] = row.n
    native_blocks, member_blocks = -(-natives // config.natives), -(-members // config.members)
    dealt_schema = pa.schema([("cell", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("native", pa.bool_()), ("home", pa.bool_()), ("rep", pa.int64()), ("times", pa.int64()), ("vector", pa.binary())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v, d in parts(batches):
            packed = pa.array([x.astype(raw).tobytes() for x in v], pa.binary())
            rep, times, home = batch.column("rep"), batch.column("times"), d.argmin(1)
            key = (rep.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            at, cell = np.nonzero(visits(d, apart, radius, r))
            for native, rows, cells in ((True, np.arange(len(d)), home), (False, at, cell)):
                ni, mj = native_blocks[cells], member_blocks[cells]
                own, copies = (ni, mj) if native else (mj, ni)
                mine = (key[rows] % own.astype(np.uint64)).astype(np.int64)
                spread = np.repeat(np.arange(len(rows)), copies)
                other = np.arange(len(spread)) - np.repeat(np.cumsum(copies) - copies, copies)
                i, j = (mine[spread], other) if native else (other, mine[spread])
                row = pa.array(rows[spread])
                columns = [pa.array(cells[spread]), pa.array(i), pa.array(j), pa.array(np.full(len(spread), native)), pa.array(home[rows[spread]] == cells[spread]), rep.take(row), times.take(row), packed.take(row)]
                yield pa.RecordBatch.from_arrays(columns, schema=dealt_schema)

    def join(block: pa.Table) -> pa.Table:
        native, member = block.filter(block["native"]), block.filter(pc.invert(block["native"]))
        if not len(native) or not len(member):
            return _LINK.empty_table()
        y, x = (np.frombuffer(b"".join(t["vector"].to_pylist()), raw).reshape(len(t), -1).astype(float) for t in (native, member))
        ids_y, ids_x = native["rep"].to_numpy(), member["rep"].to_numpy()
        count_y, count_x, (a, b) = joined_block(y, x, ids_y, ids_x, member["home"].to_numpy(), native["times"].to_numpy(), member["times"].to_numpy(), directions, config.cosine)
        ids, n = np.concatenate([ids_y, ids_x]), np.concatenate([count_y, count_x])
        return pa.table([np.concatenate([ids[n > 0], a]), np.concatenate([ids[n > 0], b]), np.concatenate([n[n > 0], np.zeros(len(a), np.int64)])], schema=_LINK)

    blocks = classes.mapInArrow(dealt, "cell long, i long, j long, native boolean, home boolean, rep long, times long, vector binary")
    return blocks.groupBy("cell", "i", "j").applyInArrow(join, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    classes = written(usable(vectors).groupBy("embedding", "size").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "vector-classes")
    every = vectors.select("vec_id", "embedding")
    found = None
    for size in classes.groupBy("size").count().where("count > 1").orderBy("size").collect():  # as many as there are lengths
        own = linked(classes.where(F.col("size") == size["size"]).select("embedding", "rep", "times"), size["count"], config)
        found = own if found is None else found.union(own)
    by_class = classes.select("embedding", "rep", "times")
    if found is None:
        by_class = by_class.withColumn("n", F.lit(0)).withColumn("component", F.col("rep"))
    else:
        found = written(found, "vector-links")
        counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        component = components(found.where("n = 0").select("a", "b")).withColumnRenamed("id", "rep")
        by_class = by_class.join(counts, "rep", "left").join(component, "rep", "left")
    by_class = by_class.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = every.join(by_class, (every["embedding"] == by_class["embedding"]) & every["vec_id"].isNotNull(), "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
