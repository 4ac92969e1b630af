"""Tables made once from files and kept in the session's shared folder, under a name that changes when the files do."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.fixpoint import shared_dir


#: Rows and bytes that a Python worker gets at once while a table is made.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile sends its rows to Python workers a few megabytes at a time: those hold many times a batch's size. The session's settings come back after it."""
    before = {key: spark.conf.get(key, None) for key in _BATCHES}
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(source: DataFrame, said: object, make: Callable[[str], object], name: str) -> str:
    """The folder of what make(folder) writes from source.

    The name tells the source's files (path, length, time) and what else `said` says of it. It is made when it is not there yet
    in full: a mark is set at the end, so a run that was cut off is done again.
    """
    spark = source.sparkSession
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def stamp(file: str) -> str:
        path = path_of(file)
        s = path.getFileSystem(conf).getFileStatus(path)
        return f"{file} {s.getLen()} {s.getModificationTime()}"

    text = "\n".join([*map(stamp, sorted(source.inputFiles())), repr(said)])
    folder = f"{shared_dir(spark)}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"
    done = path_of(f"{folder}/done")
    fs = done.getFileSystem(conf)
    if not fs.exists(done):
        make(folder)
        fs.create(done).close()
    return folder
