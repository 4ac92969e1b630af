"""Counters by window and user, the same for tables and streams, and idempotent activity.

The stream forms add a watermark, so state is dropped once a window can't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, user_id, n) of tumbling windows; a stream needs `late`, how much events may be behind."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def capped(events: DataFrame, per_minute: int, per_day: int, in_all: int | None = None) -> DataFrame:
    """events with verdict: minute, day, global or ok; caps are compared after counting, and what one refuses isn't counted by the next.

    in_all bounds a day's requests of all users: the first so many that pass are kept a day
    before anything is shuffled, so no task gets a whole day.
    """
    order = ["ts", "event_id"]
    minute = Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy(*order)
    marked = events.withColumn("_minute", F.row_number().over(minute) <= per_minute)
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy(*order)
    passed = F.sum(F.col("_minute").cast("int")).over(day)
    judged = marked.withColumn("verdict", F.when(~F.col("_minute"), "minute").when(passed > per_day, "day").otherwise("ok")).drop("_minute")
    if in_all is None:
        return judged
    first = Window.partitionBy(F.to_date("ts")).orderBy(*order)
    admitted = judged.where("verdict = 'ok'").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= in_all).select("event_id", F.lit(True).alias("_in"))
    return judged.join(admitted, "event_id", "left").withColumn("verdict", F.when((F.col("verdict") == "ok") & F.col("_in").isNull(), "global").otherwise(F.col("verdict"))).drop("_in")


def daily_active(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """One row for each user and day of a stream, however often it is delivered."""
    days = stream.select("user_id", F.date_trunc("day", "ts").alias("day")).withWatermark("day", late)
    return days.dropDuplicatesWithinWatermark(["user_id", "day"])
