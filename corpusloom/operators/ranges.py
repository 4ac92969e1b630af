"""Joins of points and intervals on integer keys, by buckets.

A plain BETWEEN join compares every pair. Here each interval touches one or two
buckets of about its own length, and each point looks up its bucket among those
of each length, so the join is an equality with a residual test, and Spark shuffles
or broadcasts it as usual. Lengths come in classes, powers of two times a width, so there are
at most some sixty, and no interval is dealt to more than two buckets however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import sweep


def _class(start: Column, end: Column, width: int) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2((end - start + 1) / width))).cast("int")


def _bucket(key: Column, kind: Column, width: int) -> Column:
    return F.floor(key / (F.lit(width) * F.pow(F.lit(2.0), kind))).cast("long")


def _classes(intervals: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The classes of length that occur, some sixty at most."""
    return sorted(r.c for r in intervals.where(F.col(start) <= F.col(end)).select(_class(F.col(start), F.col(end), width).alias("c")).distinct().collect())


def _bucketed(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    own = intervals.where(F.col(start) <= F.col(end)).withColumn("_class", _class(F.col(start), F.col(end), width))
    return own.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_class"), width), _bucket(F.col(end), F.col("_class"), width))))


def _looked_up(points: DataFrame, point: str, classes: list[int], width: int) -> DataFrame:
    every = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")
    return points.withColumn("_class", F.explode(every)).withColumn("_bucket", _bucket(F.col(point), F.col("_class"), width))


def stab(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int = 1000) -> DataFrame:
    """Every point with each interval that holds it, ends included. A point has one bucket of each class, so no pair comes twice."""
    at = _looked_up(points, point, _classes(intervals, start, end, width), width)
    return at.join(_bucketed(intervals, start, end, width), ["_class", "_bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_class", "_bucket")


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: int = 1000) -> DataFrame:
    """Pairs of intervals that share a point; a pair meets in the buckets of the longer one's class and is kept in the first that both touch."""
    (a, b), (c, d) = left_ends, right_ends
    classes = sorted({*_classes(left, a, b, width), *_classes(right, c, d, width)})
    every = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")

    def dealt(rows: DataFrame, start: str, end: str, own: str) -> DataFrame:
        rows = rows.where(F.col(start) <= F.col(end)).withColumn(own, _class(F.col(start), F.col(end), width))
        rows = rows.withColumn("_class", F.explode(F.filter(every, lambda k: k >= F.col(own))))
        return rows.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_class"), width), _bucket(F.col(end), F.col("_class"), width))))

    both = dealt(left, a, b, "_left").join(dealt(right, c, d, "_right"), ["_class", "_bucket"])
    first = _bucket(F.greatest(F.col(a), F.col(c)), F.col("_class"), width)
    longer = F.col("_class") == F.greatest("_left", "_right")
    return both.where(longer & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bucket") == first)).drop("_class", "_bucket", "_left", "_right")


def uncovered(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """Points that no interval holds."""
    return sweep.covered(points, intervals, point, start, end, n="_n").where("_n = 0").drop("_n")


def key(book: Column, chapter: Column, verse: Column) -> Column:
    """One integer for three parts."""
    return book * 1_000_000 + chapter * 1000 + verse


def parts(k: Column) -> tuple[Column, Column, Column]:
    return F.floor(k / 1_000_000).cast("int"), F.floor(k / 1000).cast("int") % 1000, (k % 1000).cast("int")


def clamped(start: Column, end: Column) -> Column:
    """The end of a range within the start's chapter: the last place (999) if it lies in another chapter."""
    return F.when(F.floor(end / 1000) == F.floor(start / 1000), end).otherwise((F.floor(start / 1000) * 1000 + 999).cast("long"))


def chapter_slices(ranges: DataFrame, chapters: DataFrame, most: int = 8) -> DataFrame:
    """ranges (id, start, end) with a row for each of their first `most` chapters: book, chapter, from_verse, to_verse, truncated, total.

    chapters: (book, chapters), the books there are. A range whose end is before its start,
    or that names no known book, has no rows. The last verse of a chapter that is not the range's last is 999.
    """
    every = chapters.select("book", F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter")).withColumn("_k", F.col("book") * 1000 + F.col("chapter"))
    r = ranges.where("end >= start").withColumn("_a", F.floor(F.col("start") / 1000).cast("long")).withColumn("_b", F.floor(F.col("end") / 1000).cast("long"))
    known = chapters.select(F.col("book").alias("_known"))
    r = r.join(F.broadcast(known), F.floor(F.col("_a") / 1000) == F.col("_known"), "left_semi").where("_a % 1000 >= 1 and _b % 1000 >= 1")
    hit = stab(every, r, "_k", "_a", "_b", 64)
    # The slices of a range are numbered from where it starts, without a sort: by how many chapters the books before hold.
    before = chapters.select("book", (F.sum("chapters").over(_by_book())).alias("_upto"), "chapters")
    at = F.broadcast(before.select("book", (F.col("_upto") - F.col("chapters")).alias("_before")))
    placed = hit.join(at, "book").join(at.withColumnRenamed("book", "_first").withColumnRenamed("_before", "_before_first"), F.floor(F.col("_a") / 1000) == F.col("_first"))
    nth = F.col("_before") + F.col("chapter") - F.col("_before_first") - F.col("_a") % 1000
    n = hit.groupBy("id").agg(F.count("*").alias("total"))
    out = placed.withColumn("_nth", nth).where(F.col("_nth") < most).join(n, "id")
    first, last = F.col("_k") == F.col("_a"), F.col("_k") == F.col("_b")
    return out.select(
        "id", "book", "chapter", F.when(first, F.greatest(F.lit(1), F.col("start") % 1000)).otherwise(1).cast("int").alias("from_verse"),
        F.when(last, F.col("end") % 1000).otherwise(999).cast("int").alias("to_verse"), (F.col("total") > most).alias("truncated"), "total",
    )


def _by_book():
    from pyspark.sql import Window

    return Window.orderBy("book").rowsBetween(Window.unboundedPreceding, 0)  # some sixty rows
