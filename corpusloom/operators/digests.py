"""Digests of sets of rows that repeat, which can be added to and subtracted from.

A row is hashed with SHA-256, whose four 64-bit words are summed over all rows,
each modulo 2**64. The sums depend on which rows there are and how often, not on
their order or partition, so what was inserted and deleted updates a stored
digest without reading the rest. Each part of a table has its own digest; those of the parts add
up to the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ("lane0", "lane1", "lane2", "lane3")
_MODULUS = "cast(18446744073709551616 as decimal(38, 0))"


def _wrapped(lane: str) -> Column:
    return F.expr(f"cast(pmod(cast({lane} as decimal(38, 0)), {_MODULUS}) as decimal(20, 0))")


def of_rows(rows: DataFrame, line: Column, *part: str) -> DataFrame:
    """(*part, n, lanes) of the rows of each part, by the text that stands for a row; a null one counts as no text of its own."""
    digest = F.sha2(F.concat(F.when(line.isNull(), "0").otherwise("1"), F.coalesce(line, F.lit(""))), 256)
    hashed = rows.select(*part, digest.alias("_h"))
    words = [F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(20, 0)") for i in range(4)]
    sums = hashed.groupBy(*part).agg(F.count("*").alias("n"), *[F.sum(w).alias(lane) for w, lane in zip(words, LANES, strict=True)])
    return sums.select(*part, "n", *[_wrapped(lane).alias(lane) for lane in LANES])


def changed(stored: DataFrame, inserted: DataFrame, deleted: DataFrame, *part: str) -> DataFrame:
    """The digests of the parts after rows were inserted and deleted, all three as of_rows() gives them; a part that no row is left of goes."""
    signed = lambda df, sign: df.select(*part, (F.col("n") * sign).alias("n"), *[(F.col(lane).cast("decimal(38, 0)") * sign).cast("decimal(38, 0)").alias(lane) for lane in LANES])
    every = signed(stored, 1).unionByName(signed(inserted, 1)).unionByName(signed(deleted, -1))
    sums = every.groupBy(*part).agg(F.sum("n").alias("n"), *[F.sum(lane).alias(lane) for lane in LANES])
    return sums.select(*part, "n", *[_wrapped(lane).alias(lane) for lane in LANES]).where("n <> 0 or " + " or ".join(f"{lane} <> 0" for lane in LANES))


def whole(parts: DataFrame) -> DataFrame:
    """(n, digest): one digest of all parts, as 64 hexadecimal digits."""
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(lane), F.lit(0)).alias(lane) for lane in LANES])
    return sums.select("n", text(*[_wrapped(lane) for lane in LANES]).alias("digest"))


def text(*lanes: Column) -> Column:
    """Lanes as hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.conv(lane.cast("string"), 10, 16), 16, "0") for lane in lanes]))
