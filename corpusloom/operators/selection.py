"""Choices from ranked rows: voices of several traditions, diverse picks, back-fill, coverage, history scores.

Greedy rules are written as windows: what a rule takes next depends only on ranks
within groups, so no row waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.relational import spread

# Weights of the signals of a history search, and the least cosine that counts as a match.
WEIGHTS = {"entity": 3.0, "period": 2.0, "cosine": 1.0, "text": 0.5}
COSINE_FLOOR = 0.6


def covers_passage(chunks: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by, covered): whether a chunk (start, end) shares a chapter with one of the ranges (start, end) asked for.

    An end that is lacking or before its start counts as the start. Who asks for no
    range isn't in the result.
    """
    chapter = lambda c: F.floor(c / 1000).cast("long")
    end = F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.col("start"))
    has = chunks.select(*by, F.explode(F.sequence(chapter(F.col("start")), chapter(end))).alias("chapter")).distinct()
    asked = ranges.select(*by, F.explode(F.sequence(chapter(F.col("start")), chapter(F.col("end")))).alias("chapter")).distinct()
    found = asked.join(has, [*by, "chapter"], "left_semi").select(*by).distinct().withColumn("covered", F.lit(True))
    return asked.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("covered", F.lit(False)).alias("covered"))


def voices(ranked: DataFrame, n: int, group: str, by: list[str]) -> DataFrame:
    """The first n rows by rank; if all are of one group and a later row isn't, the first such row takes the last place."""
    kind = F.coalesce(group, F.lit("unknown"))
    whole = Window.partitionBy(*by)
    first = F.first(kind).over(whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = ranked.withColumn("_other", kind != first)
    top = F.col("rank") <= n
    marked = marked.withColumn("_mixed", F.max(F.col("_other") & top).over(whole)).withColumn("_next", F.min(F.when(F.col("_other"), F.col("rank"))).over(whole))
    swap = ~F.col("_mixed") & F.col("_next").isNotNull()
    keep = F.when(swap, (F.col("rank") < n) | (F.col("rank") == F.col("_next"))).otherwise(top)
    return marked.where(keep).drop("_other", "_mixed", "_next")


def era(year: Column) -> Column:
    # Last years of the eras, and their names.
    return F.when(year.isNull() | (year == 0), "").when(year <= 500, "Early Church").when(year <= 1500, "Medieval").when(year <= 1700, "Reformation").otherwise("Modern")


def diverse(entries: DataFrame, most: int, by: list[str], position: str = "position") -> DataFrame:
    """At most `most` entries (author, tradition, year, position) of each group with `place` from 1.

    Groups that are small enough stay as they are. Else traditions take turns, their
    oldest entries first, with one entry an author; only if that is too few do more of
    an author's follow, tradition by tradition. Oldest first in the end.
    """
    kind = F.coalesce(F.nullif("tradition", F.lit("")), F.nullif(era(F.col("year")), F.lit("")), F.lit("Unknown"))
    whole, year = Window.partitionBy(*by), F.coalesce("year", F.lit(9999))
    # All windows are of a group, so one shuffle to tasks of bounded size serves them all.
    e = spread(entries, *by, megabytes=0.5).withColumn("_kind", kind).withColumn("_n", F.count("*").over(whole))
    e = e.withColumn("_round", F.row_number().over(Window.partitionBy(*by, "_kind").orderBy(year, position)))
    e = e.withColumn("_turn", F.min(position).over(Window.partitionBy(*by, "_kind")))
    e = e.withColumn("_first", F.row_number().over(Window.partitionBy(*by, "author").orderBy("_round", "_turn")) == 1)
    e = e.withColumn("_pick", F.when(F.col("_first"), F.row_number().over(Window.partitionBy(*by, "_first").orderBy("_round", "_turn"))))
    e = e.withColumn("_taken", F.coalesce(F.col("_pick") <= most, F.lit(False)))
    picked = F.sum(F.col("_taken").cast("int")).over(whole)
    more = F.row_number().over(Window.partitionBy(*by, "_taken").orderBy("_turn", "_round"))
    e = e.withColumn("_keep", F.col("_taken") | (more <= F.lit(most) - picked) | (F.col("_n") <= most))
    small = F.col("_n") <= most
    kept = e.where("_keep")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(small, F.col(position)).otherwise(year), F.when(small, F.lit(0)).otherwise(F.col("_turn")), "_round"))
    return kept.withColumn("place", place).select(*entries.columns, "place")


def passage_voices(entries: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """Voices (author, tradition, year, position, on_verse) with their rung: verse if those on the verse have two authors, else chapter if all have; else none are given."""
    authors = lambda c: F.size(F.collect_set(c).over(Window.partitionBy(*by)))
    e = spread(entries, *by, megabytes=0.5).withColumn("_exact", authors(F.when(F.col("on_verse"), F.col("author")))).withColumn("_all", authors(F.col("author")))
    e = e.withColumn("rung", F.when(F.col("_exact") >= 2, "verse").when(F.col("_all") >= 2, "chapter")).where(F.col("rung").isNotNull() & (F.col("on_verse") | (F.col("rung") == "chapter")))
    return diverse(e.drop("_exact", "_all"), most, by)


def backfill(ranked: DataFrame, pool: DataFrame, chapters: int = 3) -> DataFrame:
    """ranked (id, chapter, author, rank) with more voices of its leading chapters put in, as (id, chapter, author, place).

    For each of the first chapters the pool's best row (by score) of every author is
    looked up; after the chapter's first hit come those by other authors. A hit that is
    looked up so moves there. What is looked up is at most a row a chapter and author.
    """
    lead = ranked.groupBy("chapter").agg(F.min("rank").alias("major"), F.min_by("author", "rank").alias("lead_author"))
    top = lead.orderBy("major").limit(chapters)
    near = pool.join(F.broadcast(top), "chapter")
    best = near.groupBy("chapter", "author").agg(F.max_by("id", F.struct("score", (-F.col("id")).alias("o"))).alias("id"), F.first("major").alias("major"), F.first("lead_author").alias("lead_author"))
    found = best.orderBy("chapter", "author").limit(12 * chapters + 6).where(~F.col("author").eqNullSafe(F.col("lead_author")))
    minor = F.row_number().over(Window.partitionBy("chapter").orderBy("author"))
    more = found.withColumn("minor", minor).select("id", "chapter", "author", "major", "minor")
    every = ranked.select("id", "chapter", "author", F.col("rank").alias("major"), F.lit(0).alias("minor")).unionByName(more)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("major", "minor"))).where("_n = 1").drop("_n")
    return first.select("id", "chapter", "author", F.row_number().over(Window.orderBy("major", "minor")).alias("place"))


def overlaps_years(start: Column, end: Column, asked: tuple[int, int]) -> Column:
    """Whether stated years overlap those asked for; one end may be open, but no statement at all is no overlap."""
    low, high = asked
    return (start.isNotNull() | end.isNotNull()) & F.coalesce(start <= high, F.lit(True)) & F.coalesce(end >= low, F.lit(True))


def folded(legs: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Legs of candidates by id as one row an id: of the first leg that has it, with `legs`, the names of all that do."""
    every = None
    for n, (name, leg) in enumerate(legs):
        own = leg.select("id", F.lit(n).alias("_leg"), F.lit(name).alias("_name"), *[F.col(c) if c in leg.columns else F.lit(None).cast("double").alias(c) for c in columns])
        every = own if every is None else every.unionByName(own)
    first = [F.element_at(F.array_sort(F.collect_list(F.struct("_leg", F.col(c).alias("v"))))["v"], 1).alias(c) for c in columns]
    return every.groupBy("id").agg(*first, F.array_sort(F.collect_set("_name")).alias("legs"))


def history_scored(rows: DataFrame, k: int = 200) -> DataFrame:
    """rows (id, entity, period, cosine, text) that match, with their score: the best k.

    A row matches by an entity, by its years or by a cosine from the floor on; words
    alone never do. Cosine and text are cut to 0 to 1, text after division by the best.
    """
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    most = rows.agg(F.max("text").alias("most"))
    r = rows.join(F.broadcast(most)).withColumn("text", F.col("text") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)).drop("most")
    matched = F.col("entity") | F.col("period") | (F.coalesce("cosine", F.lit(0.0)) >= COSINE_FLOOR)
    score = WEIGHTS["entity"] * F.col("entity").cast("int") + WEIGHTS["period"] * F.col("period").cast("int") + WEIGHTS["cosine"] * cut(F.col("cosine")) + WEIGHTS["text"] * cut(F.col("text"))
    return r.where(matched).withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def excerpt_around(text: Column, needle: str | None = None, most: int = 420) -> Column:
    """A part of the text as it stands: its beginning, or, where the needle comes later than 60 characters, the part around it."""
    head = F.substring(text, 1, most)
    if not needle:
        return head
    at = F.locate(needle.lower(), F.lower(text)) - 1
    begin = F.least(at - 60, F.greatest(F.lit(0), F.length(text) - most))
    return F.when(at > 60, F.substring(text, begin + 1, F.lit(most))).otherwise(head)


def reranked(rows: DataFrame, score: Column, k: int, most_chars: int = 1200, text: str = "text") -> DataFrame:
    """The best k of a short candidate list by a scorer of (text cut to most_chars); any function of columns, Arrow ones too, may score."""
    cut = rows.withColumn("_scored", F.substring(text, 1, most_chars))
    return cut.withColumn("score", score).drop("_scored").orderBy(F.desc("score"), "id").limit(k)
