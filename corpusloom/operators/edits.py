"""Joins of words by edit distance, of up to two edits, through a neighbourhood of deletions.

Two words within k edits become equal when each loses k characters at most, and that
also holds for their first characters alone. So each word is filed under what
is left of its first PREFIX characters without up to k of them (at most 79 entries, however long the word
is), words meet where an entry is equal, and the distance is computed once for each pair that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 12
MOST = 2


def _shorter(word: Column) -> Column:
    """A word without one character, in all ways."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def entries(word: Column, edits: Column) -> Column:
    """What the word is filed under for up to so many edits (0 to MOST)."""
    head = F.left(word, F.lit(PREFIX))
    one = _shorter(head)
    none = F.array().cast("array<string>")
    two = F.flatten(F.transform(one, _shorter))
    return F.array_distinct(F.concat(F.array(head), F.when(edits >= 1, one).otherwise(none), F.when(edits >= 2, two).otherwise(none)))


def near(left: DataFrame, right: DataFrame, word: str, other: str, edits: str) -> DataFrame:
    """(word, other, distance) of different words of left and right within left's column edits (0 to MOST) of each other; null words meet nothing."""
    own = left.select(F.col(word).alias("_a"), F.col(edits).alias("_k")).where("_a is not null and _k is not null").groupBy("_a").agg(F.max("_k").alias("_k"))
    others = right.select(F.col(other).alias("_b")).where("_b is not null").distinct()
    met = own.select("_a", "_k", F.explode(entries(F.col("_a"), F.col("_k"))).alias("_e")).join(others.select("_b", F.explode(entries(F.col("_b"), F.lit(MOST))).alias("_e")), "_e")
    # Lengths first: most pairs that can't be near go before they are told apart.
    pairs = met.where(F.abs(F.length("_a") - F.length("_b")) <= F.col("_k")).select("_a", "_b", "_k").distinct()
    return pairs.withColumn("distance", F.levenshtein("_a", "_b", MOST)).where("distance >= 0 and distance <= _k").select(F.col("_a").alias(word), F.col("_b").alias(other), "distance")
