"""Ways to write Parquet tables: whole, new rows only, newest rows, single groups, shards.

A table that is rewritten goes to a folder beside it and takes its place when it is
whole, so a lost job leaves the old table. Each call is for one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _hadoop(spark, path)
    return files.exists(where)


def replace_table(df: DataFrame, path: str) -> None:
    """The table holds df and nothing else; df may have been read from it."""
    spark, fresh, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    where, files = _hadoop(spark, path)
    aside = _hadoop(spark, old)[0]
    if files.exists(where) and not files.rename(where, aside):
        raise OSError(f"{path} could not be moved")
    if not files.rename(_hadoop(spark, fresh)[0], where):
        raise OSError(f"{fresh} could not take the place of {path}; the old rows are in {old}")
    if files.exists(aside):
        files.delete(aside, True)
    spark.catalog.refreshByPath(path)


def insert_new(df: DataFrame, path: str, key: list[str]) -> tuple[int, int]:
    """Append rows whose key the table lacks, one a key; (inserted, skipped)."""
    spark = df.sparkSession
    one = df.dropDuplicates(key)
    if exists(spark, path):
        one = one.join(spark.read.parquet(path).select(*key), key, "left_anti").select(*df.columns)
    fresh = f"{path}.batch-{uuid.uuid4().hex}"
    one.write.parquet(fresh)
    batch = spark.read.schema(df.schema).parquet(fresh)
    inserted = batch.count()
    batch.write.mode("append").parquet(path)
    where, files = _hadoop(spark, fresh)
    files.delete(where, True)
    spark.catalog.refreshByPath(path)
    return inserted, df.count() - inserted


def upsert(df: DataFrame, path: str, key: list[str], newest: Column) -> None:
    """One row a key: the new one where there is one, by `newest` among several."""
    spark = df.sparkSession
    both = df.withColumn("_new", F.lit(1))
    if exists(spark, path):
        both = both.unionByName(spark.read.parquet(path).withColumn("_new", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), newest))
    replace_table(both.withColumn("_nth", nth).where("_nth = 1").drop("_new", "_nth"), path)


def replace_groups(df: DataFrame, path: str, key: str) -> None:
    """Rows of each key in df take the place of that key's rows; other keys stay. Keys are folders of the table."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def sharded_json(df: DataFrame, path: str, key: str, shards: int) -> None:
    """JSON lines in `shards` folders by a hash of the key, so that one key is read from one folder."""
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(shards)))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def csv_export(df: DataFrame, path: str, without: DataFrame | None = None, key: str | None = None) -> None:
    """CSV with a header, less the rows whose key `without` holds."""
    rows = df if without is None else df.join(without.select(key).distinct(), key, "left_anti").select(*df.columns)
    rows.write.mode("overwrite").option("header", True).csv(path)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str], allowed: frozenset[str]) -> None:
    """Copies of tables; none is written if a name is not allowed."""
    refused = sorted(set(names) - allowed)
    if refused:
        raise ValueError(f"not to be copied: {refused}")
    for name in names:
        replace_table(spark.read.parquet(f"{source}/{name}.parquet"), f"{target}/{name}.parquet")
