"""How alike editions of the same passages are, from one bit for each edition that holds a shingle.

rows: (edition, passage, shingle), a null shingle for a passage that an edition has but that is too short for one.
Shingles of a passage become masks, masks are counted, and from these counts come the common and the united
shingles of all pairs of editions at once: no join of editions with each other. Rows are cut from whole texts and read
several times, so what is different of them is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.fixpoint import components, kept

MOST = 62  # editions, bits of a mask


def numbered(rows: DataFrame, edition: str = "edition") -> dict[str, int]:
    """A bit for each edition, in the order of their names."""
    names = [r[0] for r in rows.select(edition).where(F.col(edition).isNotNull()).distinct().orderBy(edition).limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} editions")
    return {n: i for i, n in enumerate(names)}


def _masked(rows: DataFrame, bits: dict[str, int], edition: str) -> DataFrame:
    """rows with column _bit: two to the power of the edition's number."""
    of = F.create_map(*[x for n, i in bits.items() for x in (F.lit(n), F.lit(1 << i).cast("long"))])
    return rows.withColumn("_bit", of[F.col(edition)]).where(F.col("_bit").isNotNull())


def likeness(rows: DataFrame, edition: str = "edition", passage: str = "passage", shingle: str = "shingle") -> DataFrame:
    """(edition, other, n_passages, likeness), edition before other: the mean over passages that both have of common by united shingles. A passage for which both have none says nothing."""
    rows = _once(rows, edition, passage, shingle)
    return _likeness(rows, numbered(rows, edition), edition, passage, shingle)


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """The different rows, kept in files."""
    return kept(rows.select(*columns).distinct())


def _likeness(rows: DataFrame, bits: dict[str, int], edition: str, passage: str, shingle: str) -> DataFrame:
    if len(bits) < 2:
        return rows.sparkSession.createDataFrame([], "edition string, other string, n_passages long, likeness double")
    own = _masked(rows, bits, edition)
    there = own.groupBy(passage).agg(F.bit_or("_bit").alias("_there"))
    masks = own.where(F.col(shingle).isNotNull()).groupBy(passage, shingle).agg(F.bit_or("_bit").alias("_mask")).groupBy(passage, "_mask").agg(F.count("*").alias("_n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("edition"), F.lit(b).alias("other"), F.lit(1 << i).cast("long").alias("_i"), F.lit(1 << j).cast("long").alias("_j")) for a, i in bits.items() for b, j in bits.items() if i < j])
    has = lambda mask, bit: F.col(mask).bitwiseAND(F.col(bit)) != 0
    each = masks.join(there, passage).select(passage, "_mask", "_n", "_there", F.inline(pairs)).where(has("_there", "_i") & has("_there", "_j") & (has("_mask", "_i") | has("_mask", "_j")))
    both = F.sum(F.when(has("_mask", "_i") & has("_mask", "_j"), F.col("_n")).otherwise(0))
    of_passage = each.groupBy(passage, "edition", "other").agg((both / F.sum("_n")).alias("_alike"))
    return of_passage.groupBy("edition", "other").agg(F.count("*").alias("n_passages"), F.avg("_alike").alias("likeness"))


def families(rows: DataFrame, threshold: float, edition: str = "edition", passage: str = "passage", shingle: str = "shingle") -> DataFrame:
    """(edition, family, united, largest, cost): editions linked by a likeness of threshold or more, directly or through others, are a family, named after its first.

    united counts the family's different shingles, largest those of its richest edition, and cost is their ratio: 1 if the union adds nothing.
    """
    rows = _once(rows, edition, passage, shingle)
    bits = numbered(rows, edition)
    if not bits:
        return rows.sparkSession.createDataFrame([], "edition string, family string, united long, largest long, cost double")
    links = kept(_likeness(rows, bits, edition, passage, shingle).where(F.col("likeness") >= threshold).select(F.col("edition").alias("a"), F.col("other").alias("b")))
    linked = {r.node: r.component for r in components(links).collect()}  # a row an edition, MOST at most
    family = {n: linked.get(n, n) for n in bits}
    masks = _masked(rows, bits, edition).where(F.col(shingle).isNotNull()).groupBy(shingle).agg(F.bit_or("_bit").alias("_mask")).groupBy("_mask").agg(F.count("*").alias("_n"))
    within = {f: sum(1 << bits[n] for n in family if family[n] == f) for f in set(family.values())}
    count = lambda bit: F.coalesce(F.sum(F.when(F.col("_mask").bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("_n"))), F.lit(0))
    sizes = masks.agg(*[count(1 << i).alias(f"e{i}") for i in bits.values()], *[count(m).alias(f"f{m}") for m in within.values()])
    figures = F.array(*[
        F.struct(F.lit(n).alias("edition"), F.lit(f).alias("family"), F.col(f"f{within[f]}").alias("united"), F.greatest(*[F.col(f"e{bits[x]}") for x in family if family[x] == f], F.lit(0)).alias("largest")) for n, f in family.items()
    ])
    out = sizes.select(F.inline(figures))
    return out.withColumn("cost", F.when(F.col("largest") > 0, F.col("united") / F.col("largest")))
