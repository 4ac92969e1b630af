"""Tables that every executor can read, and fixed folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: While a table is written: shuffle files go when its query ends, and Python workers get rows in batches of bounded size.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and all
    runs in one process, as in tests, is a temporary folder made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; it outlives any executor and cuts the lineage.

    Once it is written nothing needs the shuffles that led to it, so their files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, so that heap which earlier work no longer needs goes back to the system.

    An executor's memory also holds its Python workers; a heap that once grew stays large
    beside them through all later stages. A short task for each slot; results do not depend on it.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def input_partitions(df: DataFrame, megabytes: float, least: int = 1) -> int:
    """How many parts of about `megabytes` the plan's estimated size makes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(max(least, -(-size // int(megabytes * 2**20))))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, megabytes: float) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents with at most so many megabytes of text, the same ones each time.

    The label rows are bounded before the join, so what is broadcast is bounded. Of
    rows that repeat a doc_id the one with the least text counts. Whole texts are
    taken in the order of a hash until the megabytes are used up.
    """
    few = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(train)
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    # The window holds at most `rows` ids and sizes.
    sizes = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"))).alias("least"))
    used = F.sum("least.size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fitting = sizes.withColumn("used", used).where(F.col("used") <= int(megabytes * 2**20)).select("doc_id", "label", "least")
    same = (F.octet_length("text") == F.col("least.size")) & (F.xxhash64("text") == F.col("least.hash"))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(fitting), "doc_id").where(same).select("doc_id", "text", "label").dropDuplicates(["doc_id"])


def discard(df: DataFrame) -> None:
    """Remove a table made by written() that no later step reads: what was made from it must be written by now."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
