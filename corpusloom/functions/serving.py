"""Which rows may be shown: vetoed authors, forbidden sources, published works, catalogues.

All rules are column expressions, so they run where the rows are. A rule never
turns a null into a refusal by accident: each says what a null means.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sites whose compilations are not used.
FORBIDDEN_DOMAINS = ("biblehub.com", "studylight.org", "historicalchristian.faith")
# Authors that are never shown.
VETOED_AUTHORS = (
    "Tyndale Study Notes", "Tyndale Open Study Notes", "Theophylact", "Bonaventure", "Oecumenius", "Origen", "Origen of Alexandria",
    "Aquinas-Larcher", "CS Lewis", "GK Chesterton", "Douglas Wilson", "JRR Tolkien", "Pseudo-Origen",
)
VETOED_PREFIX = "Jerome's"
# Authors shown for every book, and those shown for some books only.
PUBLISHED_AUTHORS = ("John Gill", "Jamieson, Fausset & Brown", "Adam Clarke", "Matthew Henry", "Barnes' Notes", "Albert Barnes", "John Wesley", "John Calvin")
PUBLISHED_FOR = {"John Chrysostom": (40, 43, 44), "Augustine of Hippo": (19, 43)}
# Licences that allow publishing.
ALLOWED_LICENSES = ("Public Domain", "CC BY", "CC BY-SA")
# The source types of each catalogue, and of its parts.
CATALOGS = {
    "commentaries": ("commentary", "father"), "sermons": ("sermon",), "hymns-poetry": ("hymn", "poetry"),
    "historians": ("historian",), "devotionals": ("devotional",), "theology": ("theology", "confession"),
}
SUB_CATALOGS = {("hymns-poetry", "hymns"): ("hymn",), ("hymns-poetry", "poetry"): ("poetry",)}


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def clean_provenance(url: Column, domains: Iterable[str] = FORBIDDEN_DOMAINS) -> Column:
    """Whether a source may be used: it is unknown, or holds no forbidden domain anywhere, in any case."""
    return url.isNull() | ~any_of(F.contains(F.lower(url), F.lit(d)) for d in domains)


def host(url: Column) -> Column:
    """The host of a URL in lower case, with or without a scheme; null where there is none."""
    trimmed = F.trim(url)
    whole = F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.lower(F.nullif(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit("")))


def forbidden_domain(url: Column, domains: Iterable[str] = FORBIDDEN_DOMAINS) -> Column:
    """The forbidden domain that the URL's host is or belongs to, else null."""
    name = host(url)
    return F.coalesce(*[F.when((name == d) | F.endswith(name, F.lit("." + d)), F.lit(d)) for d in domains])


def vetoed(author: Column, authors: Iterable[str] = VETOED_AUTHORS) -> Column:
    """Whether an author is on the list, under an addition ("of", "the", or anything after a blank), or in the vetoed series; a null is not."""
    names = list(authors)
    listed = any_of(part.isin(names) for part in (author, F.split_part(author, F.lit(" of "), F.lit(1)), F.split_part(author, F.lit(" the "), F.lit(1))))
    return F.coalesce(listed | any_of(author.startswith(n + " ") for n in names) | author.startswith(VETOED_PREFIX), F.lit(False))


def published(author: Column, book: Column, work: Column, works: Iterable[str] = ()) -> Column:
    """Whether an entry is shown: not vetoed, and of a published work, or by an author published for the book."""
    whole = author.isin(*PUBLISHED_AUTHORS) | any_of((author == a) & book.isin(*books) for a, books in PUBLISHED_FOR.items())
    by_work = work.isin(*works) if list(works) else F.lit(False)
    return ~vetoed(author) & F.coalesce(by_work, F.lit(False)) | ~vetoed(author) & F.coalesce(whole, F.lit(False))


def searchable(author: Column, book: Column, url: Column) -> Column:
    """Whether an entry may be found by search: an author published for the book, a clean source, no veto."""
    whole = author.isin(*PUBLISHED_AUTHORS) | any_of((author == a) & book.isin(*books) for a, books in PUBLISHED_FOR.items())
    return F.coalesce(whole, F.lit(False)) & clean_provenance(url) & ~vetoed(author)


def catalog_types(catalogs: Iterable[str], part: str | None = None) -> list[str]:
    """Source types of some catalogues together, sorted, or of a part of a single one. No catalogue, or an unknown one, adds none."""
    names = list(catalogs)
    if part is not None and len(names) == 1 and (names[0], part) in SUB_CATALOGS:
        return list(SUB_CATALOGS[names[0], part])
    return sorted({t for c in names for t in CATALOGS.get(c, ())})


def in_catalogs(source_type: Column, catalogs: Iterable[str] = (), part: str | None = None) -> Column:
    """Whether a source type is in one of the catalogues; without catalogues there is no filter."""
    names = list(catalogs)
    if not names:
        return F.lit(True)
    types = catalog_types(names, part)
    return source_type.isin(*types) if types else F.lit(False)


def optional(df: DataFrame, **equal: object) -> DataFrame:
    """Rows with the given values; a parameter that is None filters nothing and is not in the plan."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def under_key(heading: Column, key: str) -> Column:
    """Whether a heading is the key, or the key and more after a blank."""
    return (heading == key) | heading.startswith(key + " ")


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not deleted."""
    return df.where(F.col(deleted).isNull())


def servable_sections(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """(section_id) of sections that may be shown now: source published, author not vetoed, own URL clean. Only what is known to be so is in it."""
    works = sources.where((F.col("status") == "published") & ~vetoed(F.col("author"))).select("source_id")
    return sections.where(clean_provenance(F.col("source_url"))).join(works, "source_id", "left_semi").select("section_id")


def servable_sources(pool: DataFrame, keys: DataFrame) -> DataFrame:
    """(source_key) of asked keys with a served and clean row in the pool; the type is the key's part before the first colon."""
    asked = keys.select("source_key", F.split_part("source_key", F.lit(":"), F.lit(1)).alias("source_type")).distinct()
    good = pool.where(F.coalesce("served", F.lit(False)) & F.col("user_id").isNull() & clean_provenance(F.col("source_url"))).select("source_type", "source_key")
    return asked.join(good, ["source_type", "source_key"], "left_semi").select("source_key")


def block_states(blocks: DataFrame, sections: DataFrame, sources: DataFrame) -> DataFrame:
    """blocks (kind, section_id, source_key, quote, attribution, ...) with state: text, clipping or tombstone.

    A clipping shows its quote only if its section or its source is servable; one
    whose quote is gone, or of which neither is known to be, is a tombstone.
    """
    by_section = sections.select("section_id").distinct().withColumn("_section", F.lit(True))
    by_source = sources.select("source_key").distinct().withColumn("_source", F.lit(True))
    gone = F.col("quote").isNull() & F.col("attribution").isNotNull()
    state = F.when(F.col("kind") != "clipping", "text").when(gone, "tombstone").when(F.coalesce("_section", "_source", F.lit(False)), "clipping").otherwise("tombstone")
    return blocks.join(by_section, "section_id", "left").join(by_source, "source_key", "left").withColumn("state", state).drop("_section", "_source").select(*blocks.columns, "state")
