"""Files of texts as tables: JSON books and chapters, tagged words, votes, line-marked scripture.

All are DataFrame readers with declared schemas, so no pass infers one. A file is
the unit of parallel work; each holds one book or chapter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.chunking import Piece, chunked

ENTRY = "author string, work string, sourceTitle string, sourceUrl string, tradition string, year int, verseStart long, verseEnd long, text string"
# The codes of the books, in order.
BOOKS = """
GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL
MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV
""".split()


def verse_id(book: Column, chapter: Column, verse: Column) -> Column:
    return book.cast("long") * 1_000_000 + chapter.cast("long") * 1_000 + verse.cast("long")


def verses(spark: SparkSession, path: str) -> DataFrame:
    """(verse_id, text) of files {book, chapters: {chapter: [{verse, text}]}}."""
    files = spark.read.schema("book int, chapters map<string, array<struct<verse: int, text: string>>>").option("multiLine", True).json(path)
    chapters = files.select("book", F.explode("chapters").alias("chapter", "rows"))
    return chapters.select("book", "chapter", F.inline("rows")).select(verse_id(F.col("book"), F.col("chapter"), F.col("verse")).alias("verse_id"), "text")


def entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries of files {book, chapter, entries: [...]}, and the files that are no such JSON: (file, reason)."""
    reader = spark.read.schema(f"book int, chapter int, entries array<struct<{ENTRY.replace(' ', ': ').replace(',:', ',')}>>, broken string")
    files = reader.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True).json(path)
    files = files.select("*", F.col("_metadata.file_path").alias("file"))
    whole = F.col("broken").isNull() & F.col("book").isNotNull() & F.col("chapter").isNotNull() & F.col("entries").isNotNull()
    good = files.where(whole).select("file", "book", "chapter", F.posexplode("entries").alias("position", "e")).select("file", "book", "chapter", "position", "e.*")
    # Texts lacking give empty texts, numbers lacking 0; who works on none of them sees no null.
    good = good.na.fill("", ["author", "sourceUrl", "text"]).na.fill(0, ["verseStart", "verseEnd"])
    return good, files.where(~whole).select("file", F.when(F.col("broken").isNotNull(), "bad JSON").otherwise("bad shape").alias("reason"))


def occurrence_ids(rows: DataFrame, base: str, *order: str) -> DataFrame:
    """`source_id`: the base id, with #n from its second row on."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return rows.withColumn("source_id", F.when(nth == 0, F.col(base)).otherwise(F.concat_ws("#", base, nth.cast("string"))))


def commentary_chunks(entries: DataFrame, books: DataFrame, cutter: Callable[[str], Iterable[Piece]]) -> DataFrame:
    """(source_id, chunk, verse_id, verse_end, text) with what each entry says of itself, of entries() that have a text.

    books: book, slug. An id names book, chapter, verses, author and work; those that repeat are numbered
    over the whole file before empty entries go, so that none of these renumbers the rest.
    """
    work = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("sourceTitle", F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)
    verses = F.concat_ws("-", "verseStart", "verseEnd")
    named = entries.join(F.broadcast(books.select("book", "slug")), "book").withColumn("_base", F.concat_ws(":", F.lit("commentary"), "slug", "chapter", verses, "author", work))
    numbered = occurrence_ids(named, "_base", "file", "position").drop("_base").where(F.trim("text") != "")
    whole = numbered.withColumn("verse_id", verse_id(F.col("book"), F.col("chapter"), F.col("verseStart"))).withColumn("verse_end", verse_id(F.col("book"), F.col("chapter"), F.col("verseEnd")))
    pieces = chunked(whole, "source_id", cutter)
    return pieces.withColumnRenamed("ordinal", "chunk").drop("heading").join(whole.drop("text", "file", "position"), "source_id")


def tagged_words(spark: SparkSession, path: str) -> DataFrame:
    """(verse_id, position, w, l, tr, s, m, g) of files {book, chapter, verses: {verse: [word]}}."""
    word = "w: string, l: string, tr: string, s: string, m: string, g: string"
    files = spark.read.schema(f"book int, chapter int, verses map<string, array<struct<{word}>>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    by_verse = files.select("book", "chapter", F.explode("verses").alias("verse", "words"))
    return by_verse.select(verse_id(F.col("book"), F.col("chapter"), F.col("verse")).alias("verse_id"), F.posexplode("words").alias("position", "word")).select("verse_id", "position", "word.*")


def concordance(words: DataFrame) -> DataFrame:
    """(strong, verse_id), each once, of words tagged G or H and a number."""
    return words.select(F.trim("s").alias("strong"), "verse_id").where(F.col("strong").rlike("^[GH][0-9]+$")).distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def topic_votes(spark: SparkSession, path: str, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics with their references in file order, and the lines whose references name no known book.

    Lines are topic, tab, Book.chapter.verse[-Book.chapter.verse]; books are (code,
    book, name), a fixed list of under a hundred rows. A topic: (topic, body, entries).
    """
    lines = spark.read.schema("topic string, osis string, votes string").option("sep", "\t").option("header", True).csv(path)
    lines = lines.where("topic is not null and osis is not null").withColumn("position", F.monotonically_increasing_id())

    def point(which: int, prefix: str, to: DataFrame) -> DataFrame:
        parts = F.split(F.get(F.split("osis", "-"), F.lit(which)), r"\.")
        valid = (F.size(parts) == 3) & F.get(parts, F.lit(1)).rlike("^[0-9]+$") & F.get(parts, F.lit(2)).rlike("^[0-9]+$")
        named = books.select(F.col("code").alias(f"{prefix}_code"), F.col("book").alias(f"{prefix}_book"), F.col("name").alias(f"{prefix}_name"))
        found = to.withColumn(f"{prefix}_code", F.when(valid, parts[0])).join(F.broadcast(named), f"{prefix}_code", "left")
        shown = F.concat(F.col(f"{prefix}_name"), F.lit(" "), F.get(parts, F.lit(1)), F.lit(":"), F.get(parts, F.lit(2)))
        return found.withColumn(prefix, verse_id(F.col(f"{prefix}_book"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).withColumn(f"{prefix}_shown", shown)

    both = point(1, "to", point(0, "from", lines))
    ranged = F.contains("osis", F.lit("-"))
    read = F.col("from").isNotNull() & (F.col("to").isNotNull() | ~ranged)
    one = F.struct(
        "position", F.col("from").alias("start"), F.when(ranged, F.col("to")).otherwise(F.col("from")).alias("end"),
        F.when(ranged, F.concat_ws("–", "from_shown", "to_shown")).otherwise(F.col("from_shown")).alias("shown"),
    )
    topics = both.where(read).groupBy("topic").agg(F.array_sort(F.collect_list(one)).alias("entries"))
    return topics.select("topic", F.array_join("entries.shown", "; ").alias("body"), F.transform("entries", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("entries")), both.where(~read).select("topic", "osis")


def plain_usfm(text: Column) -> Column:
    """Line-marked text without notes, cross references and markers, blanks folded."""
    # What is taken out, in this order, and what takes its place.
    for pattern, put in (
        (r"(?s)\\[fx]\s.*?\\[fx]\*", ""), (r"(?s)\\\+?w\s+([^|\\]*)\|[^\\]*\\\+?w\*", "$1"),
        (r"(?i)\\\+?[a-z]+\*", ""), (r"(?i)\\\+?[a-z]+[0-9]?\s?", ""), (r"\s?\*\s?", " "), (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def usfm(spark: SparkSession, path: str) -> DataFrame:
    r"""(verse_id, text) of line-marked files, one book each, by its first \id.

    A bridge (\v 1-3) puts the text on its first verse and empty texts on the others;
    letters after a verse number play no part. Titles and other head lines are left
    out, as are books that BOOKS doesn't name.
    """
    files = spark.read.text(path, wholetext=True)
    book = F.array_position(F.array(*map(F.lit, BOOKS)), F.upper(F.regexp_extract("value", r"(?m)^\\id\s+(\S+)", 1)))
    head = r"(?m)^\\(?:h|toc[1-3]|mt[1-3]?|ms[1-3]?|mr|s[1-5]?|r|d|sp|rem|ie|cl|cd|id)\s.*$"
    after_first = lambda parts: F.filter(parts, lambda _, i: i > 0)
    chapters = files.select(book.alias("book"), F.explode(after_first(F.split(F.regexp_replace("value", head, ""), r"(?m)^\\c\s+(?=[0-9])"))).alias("c"))
    numbered = chapters.where("book > 0").select("book", F.regexp_extract("c", "^([0-9]+)", 1).alias("chapter"), F.explode(after_first(F.split("c", r"\\v\s+(?=[0-9])"))).alias("v"))
    marker = r"^([0-9]+)[a-z]?(?:[-–]([0-9]+)[a-z]?)?(?:\s|$)"
    first = F.regexp_extract("v", marker, 1).cast("int")
    last = F.coalesce(F.expr("try_cast(nullif(regexp_extract(v, '" + marker.replace("\\", "\\\\") + "', 2), '') as int)"), first)
    rows = numbered.where(F.col("v").rlike(marker)).select("book", "chapter", first.alias("first"), F.explode(F.sequence(first, F.greatest(first, last))).alias("verse"), plain_usfm(F.regexp_replace("v", marker, "")).alias("text"))
    return rows.select(verse_id(F.col("book"), F.col("chapter"), F.col("verse")).alias("verse_id"), F.when(F.col("verse") == F.col("first"), F.col("text")).otherwise("").alias("text"))
