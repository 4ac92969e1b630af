"""Reading plans: items dealt out over days, days over the calendar, as sequences and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.references import BY_SLUG
from corpusloom.operators import ranges


def reading_days(spark: SparkSession, start: str, weeks: int, week_days: list[int]) -> DataFrame:
    """(day, date): the chosen days (0-6) of each week from start on, numbered from 0 in order."""
    days = sorted(set(week_days))
    every = spark.range(weeks * len(days)).select(F.col("id").cast("int").alias("day"))
    offset = (F.col("day") / len(days)).cast("int") * 7 + F.element_at(F.array(*map(F.lit, days)), F.col("day") % len(days) + 1)
    return every.select("day", F.date_add(F.lit(start).cast("date"), offset).alias("date"))


def dealt(spark: SparkSession, items: int, days: int) -> DataFrame:
    """(day, first, last) item positions from 0, as even as floors make them; no day may stay empty."""
    if items < days:
        raise ValueError("fewer items than days")
    d = F.col("id")
    cut = lambda i: F.floor(i * items / days).cast("int")
    return spark.range(days).select(d.cast("int").alias("day"), cut(d).alias("first"), (cut(d + 1) - 1).alias("last"))


def expanded(plans: DataFrame, key: str, start: str, items: str, most_days: int, week_days: list[int]) -> DataFrame:
    """(key, day, first, last, date) of every plan: its items dealt over as many reading days as it has items, most_days at most; a plan without items or start has none."""
    days = sorted(set(week_days))
    n, k, d = F.col(items), F.least(F.col(items), F.lit(most_days)), F.col("day")
    rows = plans.where((n > 0) & F.col(start).isNotNull()).select(key, start, items, k.alias("_days"), F.explode(F.sequence(F.lit(0), k.cast("int") - 1)).alias("day"))
    cut = lambda i: F.floor(i * F.col(items) / F.col("_days")).cast("int")
    offset = (d / len(days)).cast("int") * 7 + F.element_at(F.array(*map(F.lit, days)), d % len(days) + 1)
    return rows.select(key, "day", cut(d).alias("first"), (cut(d + 1) - 1).alias("last"), F.date_add(F.to_date(start), offset).alias("date"))


def spec_fault(weeks: Column, per_week: Column, start_date: Column, book: Column) -> Column:
    """What is wrong with a plan's settings, the first fault there is: weeks, days, date or book; null if nothing is."""
    # The most weeks, and the form of a date.
    date = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
    return (
        F.when(~F.coalesce(weeks.between(1, 104), F.lit(False)), "weeks").when(~F.coalesce(per_week.between(1, 7), F.lit(False)), "days")
        .when(~F.coalesce(start_date.rlike(date), F.lit(False)), "date").when(~F.coalesce(book.isin(*BY_SLUG), F.lit(False)), "book")
    )


def refused(days: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """(by, days, covered, refused): plans of which fewer than half of the days (start, end) hold a place of `covered` (verse_id, authors) with two authors."""
    good = ranges.stab(covered.where("authors >= 2").select("verse_id"), days.select(*by, "start", "end").distinct(), "verse_id", "start", "end").select(*by, "start", "end").distinct().withColumn("_good", F.lit(1))
    both = days.join(good, [*by, "start", "end"], "left")
    n, hit = F.count("*"), F.count("_good")
    return both.groupBy(*by).agg(n.alias("days"), hit.alias("covered"), (hit * 2 < n).alias("refused"))
