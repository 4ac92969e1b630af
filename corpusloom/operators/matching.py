"""Passage and near-text matching by word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let, ocr_tokens, shingles, stem_english
from corpusloom.operators.stored import stored


def shingle_rows(texts: DataFrame, key: str, n: int, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, shingle), different ones of each row."""
    return texts.select(key, F.explode(shingles(ocr_tokens(F.col(text)) if tokens is None else tokens, n)).alias("shingle"))


def shingle_rows_of_two(texts: DataFrame, key: str, n: int, more: int, text: str = "text") -> DataFrame:
    """(key, shingle) as shingle_rows() gives them for n and for more words, from texts that are cut once; of which length a shingle is, its blanks tell."""
    both = let(ocr_tokens(F.col(text)), lambda words: F.concat(shingles(words, n), shingles(words, more)))
    return texts.select(key, F.explode_outer(both).alias("shingle")).where(F.col("shingle").isNotNull())


def passage_index(passages: DataFrame, key: str, n: int = 6, least_shingles: int = 3) -> DataFrame:
    """(key, shingle, h): the shingles of passages that have at least least_shingles of them, and a 64-bit hash to meet by."""
    index = passages.select(key, shingles(ocr_tokens(F.col("text")), n).alias("s")).where(F.size("s") >= least_shingles)
    return index.select(key, F.explode("s").alias("shingle")).withColumn("h", F.xxhash64("shingle"))


def stored_passages(passages: DataFrame, key: str, n: int = 6, least_shingles: int = 3) -> DataFrame:
    """passage_index() of passages read from files, written once in the order of h and read from there by all that match against them."""

    def make(path: str) -> None:
        passage_index(passages, key, n, least_shingles).repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{path}/shingles")

    return passages.sparkSession.read.parquet(f"{stored(passages, (key, n, least_shingles), make, 'passages')}/shingles")


def uncited_matches(docs: DataFrame, index: DataFrame, doc_key: str, passage_key: str, n: int = 6, least_hits: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_key, passage_key, hits[, carry]): passages of an index that share at least least_hits shingles with a document.

    The passages' shingles are the smaller side; Spark broadcasts them as long as
    their size allows, and shuffles by shingle beyond that. Shingles meet by a 64-bit hash and by
    themselves after it. Counts are summed before the shuffle by (document, passage).
    """
    own = docs.select(doc_key, *carry, F.explode(shingles(ocr_tokens(F.col("text")), n)).alias("shingle")).withColumn("h", F.xxhash64("shingle"))
    hits = own.join(index, ["h", "shingle"]).groupBy(doc_key, passage_key, *carry).agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= least_hits)


def anchors(explicit: DataFrame, uncited: DataFrame, keys: list[str]) -> DataFrame:
    """Explicit (confidence 1) and uncited anchors together; of one (keys, channel) the one with most hits stays."""
    every = explicit.withColumn("channel", F.lit("explicit")).unionByName(uncited.withColumn("channel", F.lit("uncited")))
    best = Window.partitionBy(*keys, "channel").orderBy(F.desc("hits"), F.desc("confidence"))
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def votes(docs: DataFrame, editions: DataFrame, doc_key: str, edition: str, n: int = 6, least: int = 25, fallback: str = "none") -> DataFrame:
    """(doc_key, edition, hits, total, confidence) of every document: the edition whose shingles it shares most.

    Shingles are counted once a document; under `least` in all, none included, the fallback is
    named with confidence 0.5; ties go to the name that sorts first.
    """
    index = shingle_rows(editions, edition, n).distinct()
    known = index.groupBy("shingle").agg(F.collect_set(edition).alias("in"))  # a shingle's editions are as few as there are editions
    own = shingle_rows(docs, doc_key, n).join(known, "shingle")
    total = own.groupBy(doc_key).agg(F.count("*").alias("total"))
    counted = own.select(doc_key, F.explode("in").alias(edition)).groupBy(doc_key, edition).agg(F.count("*").alias("hits"))
    best = counted.groupBy(doc_key).agg(F.min(F.struct((-F.col("hits")).alias("less"), F.col(edition).alias("name"))).alias("best"))
    every = docs.select(doc_key).distinct().join(total, doc_key, "left").join(best, doc_key, "left").na.fill(0, ["total"])
    enough, hits = F.col("total") >= least, F.coalesce(-F.col("best.less"), F.lit(0))
    return every.select(
        doc_key, F.when(enough, F.col("best.name")).otherwise(F.lit(fallback)).alias(edition), hits.alias("hits"), "total",
        F.when(enough, F.greatest(F.lit(0.5), F.least(F.lit(1.0), hits / F.col("total")))).otherwise(F.lit(0.5)).alias("confidence"),
    )


def overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int, text: str = "text") -> DataFrame:
    """(left_key, right_key, common, n_left, n_right, jaccard, containment) of pairs of texts with a common shingle.

    Each text is cut once: its shingles carry their number along. They meet by a 64-bit hash,
    and by themselves after it.
    """

    def sets(df: DataFrame, key: str, size: str) -> DataFrame:
        own = df.select(key, shingles(ocr_tokens(F.col(text)), n).alias("s"))
        # An outer explode: from an inner one the optimiser would infer that s has elements, and cut each text again to test it.
        rows = own.select(key, F.size("s").cast("long").alias(size), F.explode_outer("s").alias("shingle"))
        return rows.where(F.col("shingle").isNotNull()).withColumn("h", F.xxhash64("shingle"))

    a, b = sets(left, left_key, "n_left"), sets(right, right_key, "n_right")
    common = a.join(b, ["h", "shingle"]).groupBy(left_key, right_key).agg(F.count("*").alias("common"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"))
    return common.select(
        left_key, right_key, "common", "n_left", "n_right",
        (F.col("common") / (F.col("n_left") + F.col("n_right") - F.col("common"))).alias("jaccard"),
        (F.col("common") / F.least("n_left", "n_right")).alias("containment"),
    )


def classified(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """pairs with class: match (jaccard), truncated (containment), differ."""
    return pairs.withColumn("class", F.when(F.col("jaccard") >= threshold, "match").when(F.col("containment") >= threshold, "truncated").otherwise("differ"))


# Words that may begin a gloss without being part of it.
LEADERS = ("a", "an", "the", "to", "x")


def gloss_tokens(gloss: Column) -> Column:
    """Words of a gloss, lower-cased letters only, without a leading article."""
    words = F.filter(F.transform(F.split(gloss, "[^A-Za-z'’]+"), lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), "['’]s\\b", ""), "[^a-z]", "")), lambda w: w != "")
    return F.when((F.size(words) > 1) & F.get(words, 0).isin(*LEADERS), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))).otherwise(words)


def word_senses(asked: DataFrame, words: DataFrame, key: str, gloss: str, position: str, english: str = "english") -> DataFrame:
    """(english, key, first) of words whose gloss claims an English word: by its own form where any does, else by an equal stem; one a key, at its first position."""
    tokens = words.select(key, position, F.explode(gloss_tokens(F.col(gloss))).alias("token")).withColumn("_stem", stem_english(F.col("token")))
    hit = asked.select(english, stem_english(F.col(english)).alias("_stem")).join(tokens, "_stem")
    found = hit.groupBy(english, key).agg(F.bool_or(F.col("token") == F.col(english)).alias("exact"), F.min(position).alias("first"))
    any_exact = F.bool_or("exact").over(Window.partitionBy(english))
    return found.withColumn("_any", any_exact).where(F.col("exact") | ~F.col("_any")).select(english, key, "first")
