"""Relational shapes that queries share: best of a group, pages, merges, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str, megabytes: float = 2.0, most: int = 4096) -> DataFrame:
    """df dealt over tasks of about `megabytes` each as the plan estimates its size, one a core at least and `most` at most: by keys, else in turn.

    A file is read by as many tasks as it has row groups, which may be one; and a session's number of
    shuffle partitions does not grow with a table. Work that is heavy for each row, or that sorts its groups, gets its tasks here.
    Best on what was read, before joins, whose estimates are products.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(most, -(-size // int(megabytes * 2**20))))
    return df.repartition(tasks, *keys)


def best_of(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0, most_size: int = 100, most_offset: int = 100_000) -> DataFrame:
    """One page, with size and offset clamped."""
    return df.orderBy(*order).offset(min(max(offset, 0), most_offset)).limit(min(max(size, 1), most_size))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int, descending: bool = False) -> DataFrame:
    """The next page after a key: a filter that reaches the scan, instead of skipped rows. Keys must be unique together."""
    if after is not None:
        past = F.lit(False)
        for i, (key, value) in enumerate(zip(keys, after, strict=True)):
            here = F.col(key) < F.lit(value) if descending else F.col(key) > F.lit(value)
            for k, v in zip(keys[:i], after[:i], strict=True):
                here = here & (F.col(k) == F.lit(v))
            past = past | here
        df = df.where(past)
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys]).limit(size)


def capped_count(df: DataFrame, cap: int = 1000) -> DataFrame:
    """(total, capped): counting stops at the cap."""
    return df.limit(cap).agg(F.count("*").alias("total")).withColumn("capped", F.col("total") >= cap)


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not there yet; one of each key."""
    return rows.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both together, the highest version of each key."""
    return best_of(existing.unionByName(rows), keys, [F.desc(version)])


def replace_by_key(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and the existing ones of other keys."""
    return existing.join(rows.select(keys).distinct(), keys, "left_anti").select(existing.columns).unionByName(rows)


def islands(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """df with `island`, which is constant in each run of equal values within a group, and differs between runs of a value."""
    by = Window.partitionBy(*group).orderBy(order)
    runs = Window.partitionBy(*group, value).orderBy(order)
    return df.withColumn("island", F.row_number().over(by) - F.row_number().over(runs))


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left and right value, class: missing_left, missing_right, equal or differs (nulls are equal)."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("differs")
    return a.join(b, keys, "full").select(*keys, "left_value", "right_value", kind.alias("class"))
