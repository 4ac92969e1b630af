"""A work queue as tables: claims, retirement, outcomes, figures; and logs that only grow.

Claims are made for many owners in one job: what a row lock does for one worker, a window
does for all. Documents walk queued, parsing, chunking, embedding, ready; failed and empty end
the walk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses in which a worker holds a document, minutes after which it counts as dead, attempts, and sections of one owner from which a warning is due.
CLAIMED = ("parsing", "chunking", "embedding")
STALE_MINUTES = 5
MOST_ATTEMPTS = 3
TRIPWIRE = 20_000


def _stale(now: Column) -> Column:
    return F.col("status").isin(*CLAIMED) & (F.col("claimed_at") < now - F.expr(f"interval {STALE_MINUTES} minutes"))


def claimed(documents: DataFrame, now: Column, by: str = "user_id") -> DataFrame:
    """documents (user_id, doc_id, status, claimed_at, created_at, attempts) after each owner's next one is claimed, with `taken`.

    Queued ones and those whose worker died may be claimed, while attempts are left; those
    never claimed come first, then the oldest.
    """
    free = (F.col("attempts") < MOST_ATTEMPTS) & ((F.col("status") == "queued") | F.coalesce(_stale(now), F.lit(False)))
    first = F.row_number().over(Window.partitionBy(by, "_free").orderBy(F.asc_nulls_first("claimed_at"), "created_at", "doc_id"))
    d = documents.withColumn("_free", free).withColumn("taken", F.col("_free") & (first == 1)).drop("_free")
    return d.withColumns({
        "status": F.when(F.col("taken"), "parsing").otherwise(F.col("status")), "claimed_at": F.when(F.col("taken"), now).otherwise(F.col("claimed_at")),
        "attempts": F.col("attempts") + F.col("taken").cast("int"),
    })


def reaped(documents: DataFrame, now: Column) -> DataFrame:
    """documents with those failed whose worker died at the last attempt, and why."""
    lost = F.coalesce(_stale(now), F.lit(False)) & (F.col("attempts") >= MOST_ATTEMPTS)
    why = F.concat(F.lit("Gave up after "), F.col("attempts").cast("string"), F.lit(" attempts. The last error was: "), F.coalesce("parse_error", F.lit("unknown")))
    return documents.withColumn("parse_error", F.when(lost, why).otherwise(F.col("parse_error"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def outcome(documents: DataFrame) -> DataFrame:
    """Claimed documents with the status their attempt ends in, by what it found.

    Columns: stored, refusal (a code, or null), chunks, error, permanent, attempts. A refusal ends
    the walk; an error sends back to the queue while attempts are left, unless it can't succeed.
    """
    again = F.when(F.col("permanent") | (F.col("attempts") >= MOST_ATTEMPTS), "failed").otherwise("queued")
    status = (
        F.when(~F.col("stored"), "failed").when(F.col("refusal") == "empty", "empty").when(F.col("refusal").isNotNull(), "failed")
        .when(F.col("error").isNotNull(), again).when(F.col("chunks") == 0, "empty").otherwise("ready")
    )
    return documents.withColumn("status", status)


def figures(documents: DataFrame, sections: DataFrame, now: Column, by: str = "user_id") -> DataFrame:
    """(user_id, depth, oldest_seconds, sections, over) of each owner: documents on their way, the oldest one's age, and whether a warning is due."""
    waiting = documents.where(F.col("status").isin("queued", *CLAIMED)).groupBy(by).agg(F.count("*").alias("depth"), F.min("created_at").alias("_first"))
    n = sections.groupBy(by).agg(F.count("*").alias("sections"))
    both = waiting.join(n, by, "full")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.date_trunc("second", F.col("_first")))
    return both.select(by, F.coalesce("depth", F.lit(0)).alias("depth"), age.alias("oldest_seconds"), F.coalesce("sections", F.lit(0)).alias("sections"), (F.coalesce("sections", F.lit(0)) > TRIPWIRE).alias("over"))


def breaker(works: DataFrame, by: str = "run_id", in_a_row: int = 3, rate: float = 0.3, least: int = 4, staged_cap: int = 30, most_seconds: int = 21_600) -> DataFrame:
    """(run_id, breaker, action) of runs that must stop, by their works (run_id, seq, code, staged, rate_limited, elapsed).

    The last failures all of one code, then the share of failures, then an exhausted provider or
    the time, then what was staged; the first that holds is named.
    """
    failed = F.col("code").isNotNull()
    codes = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("seq", "code")))), lambda x: x["code"])
    n = works.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("bad"), F.slice(F.reverse(codes), 1, in_a_row).alias("tail"), F.coalesce(F.bool_or("rate_limited"), F.lit(False)).alias("limited"),
        F.count_if("staged").alias("staged"), F.max("elapsed").alias("elapsed"),
    )
    same = (F.size("tail") == in_a_row) & (F.size(F.array_distinct("tail")) == 1)
    kind = (
        F.when(same, "consecutive-failure").when((F.col("n") >= least) & (F.col("bad") / F.col("n") > rate), "quarantine-rate")
        .when(F.col("limited") | (F.col("elapsed") >= most_seconds), "budget").when(F.col("staged") >= staged_cap, "staged-backlog")
    )
    halts = kind.isin("consecutive-failure", "quarantine-rate")
    return n.select(by, kind.alias("breaker"), F.when(halts, "halt").otherwise("pause").alias("action")).where("breaker is not null")


def append_log(rows: DataFrame, path: str) -> bool:
    """Append to a log; a log that can't be written must not stop what it reports on, so the failure is returned."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        return False
    return True


def stream_log(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A running query that appends a stream's rows to a log, each once however often it restarts; it reads what is there and stops."""
    return shape(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
