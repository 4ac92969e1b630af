"""Checks before texts are let in: licences, sources, keys, versification, sanity, scans, front matter, manifests.

A check gives the rows that break it, with a reason; a gate is the list of its checks with
how many rows each found. Nothing is changed by a check.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.serving import ALLOWED_LICENSES, clean_provenance, forbidden_domain, vetoed
from corpusloom.operators import edits

# Most verses that an edition's chapter may have more or less, and larger differences of known editions.
TOLERANCE, MOST_VARIANTS = 1, 25
KNOWN_VARIANTS = {("mrk", 9): (-2,), ("rom", 14): (3,), ("rom", 16): (-2,)}
# References of characters that would break a quotation.
QUOTE_BREAKING = r"(?i)&(?:#x?[0-9a-f]+|rsquo|lsquo|rdquo|ldquo|sbquo|bdquo|mdash|ndash|hellip|apos|quot|amp|nbsp|[a-z]?acute|[a-z]?grave|[a-z]?circ|[a-z]?uml|[a-z]?tilde|ccedil|szlig|aelig|oslash);"
# What a failure's message says, and the class it makes, in the order of looking.
FAILURES = (
    ("embed-429", r"(?i)429|rate.?limit|engine_overloaded|quota"),
    ("fetch", r"(?i)ECONNREFUSED|ECONNRESET|ETIMEDOUT|fetch failed|getaddrinfo|socket hang up|HTTP 5\d\d|HTTP 4\d\d"),
    ("license", r"(?i)licen[cs]e|provenance|forbidden domain"),
    ("parse", r"(?i)parse|empty|no sections|no units|no text|structure|versification|malformed"),
)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(position, id, reason) of entries (position, id, title, author, license, url, edition, year, quarantine); every fault is listed."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    m = manifest.withColumn("_n", F.when(~_blank(F.col("id")), nth))
    named = F.when(_blank(F.col("id")), F.concat(F.lit("["), F.col("position"), F.lit("]"))).otherwise(F.col("id"))
    domain = forbidden_domain(F.col("url"))
    faults = [
        (_blank(F.col("id")), F.lit("id is missing")), (F.coalesce(F.col("_n") > 1, F.lit(False)), F.lit("duplicate id")),
        (_blank(F.col("title")), F.lit("title is missing")), (_blank(F.col("author")), F.lit("author is missing")),
        (F.coalesce(F.col("license"), F.lit("")) == "", F.lit("license is missing")),
        ((F.col("license") != "") & ~F.col("license").isin(*ALLOWED_LICENSES), F.lit("license is not allowed")),
        (_blank(F.col("url")), F.lit("url is missing")), (_blank(F.col("edition")), F.lit("edition is missing")),
        (F.coalesce(F.col("year").cast("string"), F.lit("")) == "", F.lit("year is missing")),
        (domain.isNotNull() & _blank(F.col("quarantine")), F.concat(F.lit("forbidden source "), domain)),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), reason) for when, reason in faults]))
    return m.select("position", named.alias("id"), F.explode(reasons).alias("reason"))


def versification(counts: DataFrame, canon: DataFrame) -> DataFrame:
    """(edition, book, chapter, got, want, class) of chapters that differ from the canon: variant or error.

    counts: (edition, book, chapter, verses, empty) of each edition's chapters; canon: (book, chapter, verses).
    Books that an edition lacks are no fault, nor are those nearly all of whose verses are
    empty; of a book that is there every chapter is expected, and none beyond.
    """
    per_book = counts.groupBy("edition", "book").agg((F.sum("empty") > 0.9 * F.sum("verses")).alias("skeleton"))
    real = per_book.where(~F.coalesce("skeleton", F.lit(False))).select("edition", "book")
    want = real.join(canon.select("book", "chapter", F.col("verses").alias("want")), "book")
    got = counts.join(real, ["edition", "book"], "left_semi").select("edition", "book", "chapter", F.col("verses").alias("got"))
    both = want.join(got, ["edition", "book", "chapter"], "full").where(~F.col("want").eqNullSafe(F.col("got")))
    delta = F.col("got") - F.col("want")
    known = F.lit(False)
    for (book, chapter), deltas in KNOWN_VARIANTS.items():
        known = known | ((F.col("book") == book) & (F.col("chapter") == chapter) & delta.isin(*deltas))
    kind = F.when(F.coalesce(F.abs(delta) <= TOLERANCE, F.lit(False)) | F.coalesce(known, F.lit(False)), "variant").otherwise("error")
    return both.select("edition", "book", "chapter", "got", "want", kind.alias("class"))


def versification_verdicts(differences: DataFrame, editions: DataFrame, most: int = MOST_VARIANTS) -> DataFrame:
    """(edition, variants, errors, ok): an edition fails with any error, or with too many variants."""
    n = differences.groupBy("edition").agg(F.count_if(F.col("class") == "variant").alias("variants"), F.count_if(F.col("class") == "error").alias("errors"))
    every = editions.select("edition").distinct().join(n, "edition", "left").na.fill(0, ["variants", "errors"])
    return every.withColumn("ok", (F.col("errors") == 0) & (F.col("variants") <= most))


def sanity(entries: DataFrame, sample: int | None = None, key: str = "id") -> DataFrame:
    """(id, reason) of entries (id, text, verse_start, verse_end, chapter) that can't be right.

    With sample, only so many entries are looked at, the first by a hash of the key, the same ones each time.
    """
    if sample is not None:
        entries = entries.orderBy(F.xxhash64(key), key).limit(sample)
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.trim(text) == "", "empty text").when(text.rlike(QUOTE_BREAKING), "quote-breaking entity").when(text.rlike(r"(?i)</?[a-z][^>]*>"), "residual tag")
    sane = (F.col("verse_start") >= 1) & (F.col("verse_end") >= F.col("verse_start")) & (F.col("verse_end") <= 200) & (F.col("chapter") >= 1)
    keys = F.when(~F.coalesce(sane, F.lit(False)), "insane keys")
    return entries.select(key, F.explode(F.array_compact(F.array(body, keys))).alias("reason"))


def failure_class(message: Column) -> Column:
    """The class of a failure by what its message says; "unknown" for all else."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in FAILURES:
        out = out.when(message.rlike(pattern), name)
    return out.otherwise("unknown")


def collapsed_keys(entries: DataFrame, least: int = 200, share: float = 0.2) -> DataFrame:
    """(author, n, rate) of authors with so many entries (author, verse_start, verse_end, chapter) whose verse is just the chapter."""
    same = (F.col("verse_start") == F.col("verse_end")) & (F.col("verse_start") == F.col("chapter"))
    n = entries.groupBy("author").agg(F.count("*").alias("n"), F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("rate"))
    return n.where((F.col("n") >= least) & (F.col("rate") >= share))


def served_violations(entries: DataFrame) -> DataFrame:
    """(author, rule, n) of served entries (author, url, served) with a forbidden source or by a vetoed author."""
    served = entries.where(F.coalesce("served", F.lit(False)))
    rules = F.array_compact(F.array(F.when(forbidden_domain(F.col("url")).isNotNull(), "served-provenance"), F.when(vetoed(F.col("author")), "must-not-serve")))
    return served.select("author", F.explode(rules).alias("rule")).groupBy("author", "rule").agg(F.count("*").alias("n"))


def gate(checks: Iterable[tuple[str, str, DataFrame]]) -> DataFrame:
    """(gate, tier, found, ok) of named checks, each a table of what it found; tier is irreversible or reversible."""
    out = None
    for name, tier, rows in checks:
        one = rows.agg(F.count("*").alias("found")).select(F.lit(name).alias("gate"), F.lit(tier).alias("tier"), "found", (F.col("found") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def reconciled(works: DataFrame, sources: DataFrame) -> DataFrame:
    """(work, class) of works (work, rows, served, unserved_clean, unserved_forbidden) against sources (work, status).

    Published works must serve all clean rows, others none, and what serves must have a source.
    """
    w, s = works.withColumn("_w", F.lit(True)), sources.select("work", "status", F.lit(True).alias("_s"))
    unserved = F.col("rows") - F.col("served")
    clean, forbidden = F.coalesce("unserved_clean", unserved), F.coalesce("unserved_forbidden", F.lit(0))
    published = F.col("status") == "published"
    kind = (
        F.when(F.col("_w").isNull(), F.when(published, "published-workless"))
        .when(F.col("_s").isNull(), F.when(F.col("served") > 0, "no-source-serving").otherwise("inert-orphan"))
        .when(published & (clean > 0), "published-not-fully-served").when(published & (forbidden > 0), "deferred")
        .when(published, "published-served").when(F.col("served") > 0, "unpublished-serving").otherwise("unpublished-unserved")
    )
    return w.join(s, "work", "full").select("work", kind.alias("class")).where("class is not null")


# ---- scanned text


def garbage_line(line: Column) -> Column:
    """A line of scanned text with runs of marks, few letters, or two tokens of letters and digits; a blank line isn't."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    solid = F.regexp_replace(t, r"\s+", "")
    letters = F.length(F.regexp_replace(solid, r"[^a-zA-ZÀ-ɏͰ-Ͽἀ-῿]", ""))
    mixed = F.size(F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) >= 3) & w.rlike(r"(?i)[a-z][0-9]|[0-9][a-z]")))
    # The share of letters that a line of four or more characters needs, and the runs and tokens that none has.
    return (t != "") & (t.rlike(r"([^A-Za-z0-9_])\1{4,}") | ((F.length(solid) >= 4) & (letters / F.length(solid) < 0.45)) | (mixed >= 2))


def without_chrome(lines: DataFrame, by: list[str], entry_start: Column, position: str = "position", line: str = "line", unit: str | None = None) -> DataFrame:
    """lines with class: kept, blank, frequent, page_number or guide.

    Frequent are short lines that come ten times or more in a group; guides, short lines
    of three words at most between blank ones that open no entry. Lines of a group are in the order of
    their position, or of their unit and their position in it: then no task sorts more
    than a unit's lines, and only what units begin and end with is sorted by group.
    """
    t = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    own = [*by, *([unit] if unit else [])]
    rows = lines.withColumn("_t", t).withColumn("_empty", F.coalesce(F.col("_t") == "", F.lit(True)))
    same = lambda left, right, keys: [left[k].eqNullSafe(right[f"_by_{k}"]) for k in keys]
    # Characters, words and times.
    short = rows.where((F.length("_t") <= 42) & ~F.col("_empty"))
    often = short.groupBy(*[F.col(k).alias(f"_by_{k}") for k in [*by, "_t"]]).agg(F.count("*").alias("_n")).where("_n >= 10")
    rows = rows.join(often, same(rows, often, by) + [rows["_t"] == often["_by__t"]], "left").drop(*[f"_by_{k}" for k in [*by, "_t"]])
    order = Window.partitionBy(*own).orderBy(position)
    before, after = F.lag("_empty").over(order), F.lead("_empty").over(order)
    if unit:
        ends = lines.withColumn("_empty", F.coalesce(t == "", F.lit(True))).groupBy(*[F.col(k).alias(f"_by_{k}") for k in own]).agg(F.min_by("_empty", position).alias("_first"), F.max_by("_empty", position).alias("_last"))
        units = Window.partitionBy(*[f"_by_{k}" for k in by]).orderBy(f"_by_{unit}")
        ends = ends.withColumn("_before", F.lag("_last").over(units)).withColumn("_after", F.lead("_first").over(units)).drop("_first", "_last")
        rows = rows.join(ends, same(rows, ends, own), "left").drop(*[f"_by_{k}" for k in own])
        before, after = F.coalesce(before, "_before"), F.coalesce(after, "_after")
    rows = rows.withColumn("_alone", F.coalesce(before, F.lit(True)) & F.coalesce(after, F.lit(True)))
    guide = F.col("_alone") & (F.length("_t") <= 32) & (F.size(F.split("_t", r"\s+")) <= 3) & ~F.coalesce(entry_start, F.lit(False))
    kind = F.when(F.col("_t") == "", "blank").when(F.col("_n").isNotNull(), "frequent").when(F.col("_t").rlike(r"^\d{1,4}$"), "page_number").when(guide, "guide").otherwise("kept")
    return rows.withColumn("class", kind).select(*lines.columns, "class")


def edition_faults(texts: DataFrame, markers: list[str], head: int = 60_000, text: str = "text") -> DataFrame:
    """texts whose first characters lack a marker (a regular expression), with the markers that are missing."""
    start = F.substring(text, 1, head)
    missing = F.array_compact(F.array(*[F.when(~start.rlike(m), F.lit(m)) for m in markers]))
    return texts.withColumn("missing", missing).where(F.size("missing") > 0)


# Characters that scans confuse, by the one that stands for them all.
CONFUSED = {
    "a": "a4αλ", "b": "bq0689βθ", "c": "cz{}()¢ζ", "d": "dδφ", "e": "e€ε", "f": "f", "h": "h", "i": "ijl1|!ι", "k": "kκ", "m": "m7π", "n": "nη",
    "o": "oοσ", "p": "pρ", "r": "r", "s": "sς", "t": "tτ", "u": "guvyγμνυψ", "w": "w@ω", "x": "x£ξχ",
}
# Greek vowels with marks, of which the marks are left out.
_MARKED = str.maketrans("άέήίόύώϊϋΐΰ", "αεηιουωιυιυ")


def skeleton(word: Column) -> Column:
    """A word with every character replaced by its class of confused ones; other characters go. Marks of Latin and Greek vowels play no part."""
    plain = F.translate(F.lower(word), "".join(map(chr, _MARKED)), "".join(map(chr, _MARKED.values())))
    plain = F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    known = "".join(CONFUSED.values())
    kept = F.regexp_replace(plain, f"[^{known.replace('{', '').replace('}', '').replace('|', '').replace('(', '').replace(')', '')}{{}}()|]", "")
    return F.translate(kept, known, "".join(c * len(v) for c, v in CONFUSED.items()))


def recognised(entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """entries (key) with lemma and distance: the vocabulary's word (lemma, form) nearest by skeleton, within what the length allows; nulls where none is.

    Skeletons meet through their neighbourhoods of deletions (operators.edits).
    """
    own = entries.withColumn("_s", skeleton(F.col("key"))).withColumn("_n", F.length("_s"))
    # Edits allowed for skeletons of up to 3, up to 6 and more characters.
    budget = F.when(F.col("_n") <= 3, 0).when(F.col("_n") <= 6, 1).otherwise(2)
    own = own.withColumn("_most", budget)
    words = vocabulary.withColumn("_v", skeleton(F.col("form"))).where(F.length("_v") > 0).select("lemma", "_v", F.length("_v").alias("_m")).distinct()
    pairs = edits.near(own.where("_n >= 3"), words, "_s", "_v", "_most")
    near = pairs.join(words, "_v")
    best = near.groupBy("_s").agg(F.min(F.struct("distance", "_m", "lemma")).alias("best")).select("_s", F.col("best.lemma").alias("lemma"), F.col("best.distance").alias("distance"))
    return own.join(best, "_s", "left").drop("_s", "_n", "_most")


# ---- title pages and front matter


def gospel_votes(texts: DataFrame, key: str, text: str = "text", head: int = 20_000) -> DataFrame:
    """(key, gospel, volume) by the most mentions of "ST. <gospel> ... VOL. <numeral>" in a text's head, or else of "ST. <gospel>"; nulls if there is none."""
    start = F.substring(text, 1, head)
    with_volume = r"ST[.\s]+([A-Za-z0-9]{2,10})[.\s]+VO[LX][.\sI]*?([IVXLl]{1,4})\b"
    # How scans begin the names.
    of = lambda w: F.when(w.startswith("MAT"), "MATTHEW").when(w.startswith("MAR") | (w == "MK"), "MARK").when(w.startswith("LU"), "LUKE").when(w.startswith("JOH") | w.startswith("JON"), "JOHN")
    named = lambda p: F.array_compact(F.transform(F.regexp_extract_all(start, F.lit(p), 1), lambda w: of(F.upper(w))))
    full, bare = named(with_volume), named(r"ST[.\s]+([A-Za-z0-9]{2,10})\b")
    found = texts.select(key, F.when(F.size(full) > 0, full).otherwise(bare).alias("_g"), F.get(F.filter(F.arrays_zip(F.regexp_extract_all(start, F.lit(with_volume), 1).alias("g"), F.regexp_extract_all(start, F.lit(with_volume), 2).alias("v")), lambda x: of(F.upper(x["g"])).isNotNull()), 0)["v"].alias("_v"))
    numeral = F.regexp_replace(F.upper("_v"), "L(?=L|$)", "I")
    # Volumes that there are.
    volume = F.when(numeral == "I", 1).when(numeral == "II", 2).when(numeral == "III", 3).when(numeral.isin("IV", "IIII"), 4)
    names = F.array(*map(F.lit, ["MATTHEW", "MARK", "LUKE", "JOHN"]))
    # The most votes win; of equals the one that is named first.
    tally = F.transform(F.array_distinct("_g"), lambda g: F.struct(F.size(F.filter("_g", lambda x: x == g)).alias("n"), (-F.array_position("_g", g)).alias("first"), g.alias("g")))
    return found.select(key, F.when(F.size(F.array_intersect("_g", names)) > 0, F.array_max(tally)["g"]).alias("gospel"), volume.alias("volume"))


def titles_agree(pairs: DataFrame) -> Column:
    """Whether two title pages (gospel, volume, other_gospel, other_volume) may be of one work: the same gospel, and no two volumes."""
    return F.coalesce(F.col("gospel") == F.col("other_gospel"), F.lit(False)) & F.coalesce(F.col("volume") == F.col("other_volume"), F.lit(True))


# Titles of front matter, and of what such a title may be followed by when it names a book.
_LABELS = "preface|introduction|argument|contents|table\\s+of\\s+contents|dedication|dedicatory\\s+epistle|title\\s+page|prolegomena|advertisement|to\\s+the\\s+reader|the\\s+epistle\\s+dedicatory"
_SCOPE = r"(?:\s*[—–-]?\s*(?:to|of|for|on)\s+[^.;:!?]{0,80})?"
_BOOKISH = (
    r"(?i)^\s*(?:the\s+)?(?:" + _LABELS + r")\s*[—–-]?\s*(?:to|of|on)\s+(?:the\s+)?(?:gospels?|epistles?|books?|prophecy|prophet|acts|revelation|apocalypse|psalter|psalms?|pentateuch"
    r"|volume|edition|works?|treatise|commentary|reader|following|present|whole|first|second|third|fourth|new\s+testament|old\s+testament|st\.?\s|saint\s)"
)
_LANGUAGES = "latin|greek|german|french|hebrew|syriac|arabic|aramaic|chaldee|english|scotch|scottish|anglo-saxon|saxon|spanish|italian|dutch|welsh|gaelic|ethiopic|coptic|persian|sanskrit"


def front_matter(entries: DataFrame, heading: str = "heading", body: str = "body") -> DataFrame:
    """entries with kind and strength of what makes them no text by the author: titles of front matter, numerals alone, word indexes, price lists; nulls for all others.

    The label must be the title itself: the heading, or a first line that stands alone.
    """
    h, b = F.trim(F.coalesce(heading, F.lit(""))), F.coalesce(body, F.lit(""))
    stripped = F.regexp_replace(b, r"^\s+|\s+$", "")
    first = F.trim(F.regexp_extract(stripped, r"^([^\r\n]*)", 1))
    # Characters of a title, of a body that is nothing but its title, and of numerals alone.
    title = F.substring(F.when(h != "", h).otherwise(first), 1, 160)
    alone = (h != "") | stripped.rlike(r"\S[^\n]*\n") | (F.length(stripped) <= 60)
    label = rf"(?i)^\s*(?:the\s+)?(?:{_LABELS}){_SCOPE}\s*[.:;—–-]*\s*$"
    bare = rf"(?i)^\s*(?:the\s+)?(?:{_LABELS})\s*[.:;—–-]*\s*$"
    is_label = (title != "") & (F.length(title) <= 70) & alone & title.rlike(label)
    numerals = (stripped != "") & (F.length(stripped) <= 120) & stripped.rlike(r"(?i)^[\s.,;:()\[\]—–-]*(?:[ivxlcdm]+[\s.,;:()\[\]—–-]*)+$")
    index = (F.length(title) <= 70) & title.rlike(rf"(?i)^\s*(?:index\s+of\s+)?(?:(?:{_LANGUAGES})\b[\s,&]*?(?:\band\b)?\s*)+words?\s+and\s+phrases?(?:\s*\([^)]{{0,60}})?\s*[.:]?\s*$")
    lines = F.filter(F.split(stripped, r"\r?\n"), lambda x: F.trim(x) != "")
    priced = lambda x: F.trim(x).rlike(r"^_?s\._?\s+_?d\._?$|\s{3,}\d{1,2}\s+\d{1,2}\s*$|^\d{1,2}\s+\d{1,2}$|\d+\s?s\.\s*(?:\d+\s?d\.)?\s*$|\$\s?\d+(?:\.\d{1,2})?\s*$|(?i)\b\d+\s?cents?\b|^-{4,}\s*\S")
    prices = (F.size(lines) >= 6) & (F.size(F.filter(lines, priced)) >= 0.6 * F.size(lines))
    kind = F.when(is_label, "apparatus-title").when(numerals, "roman-numeral-body").when(index, "word-index-title").when(prices, "publisher-price-list-body")
    strength = F.when(is_label & ~title.rlike(bare) & ~title.rlike(_BOOKISH), "weak").when(kind.isNotNull(), "strong")
    return entries.withColumn("kind", kind).withColumn("strength", strength)


# ---- moving rows out and back


def entry_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A digest of a row's columns and values, in the order of their names; only equal rows have equal ones."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def quarantined(served: DataFrame, quarantine: DataFrame | None, admitted: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays served, the quarantine with the rest added): equal rows are held once. Write the second before the first takes its place."""
    out = served.where(~F.coalesce(admitted, F.lit(False)))
    held = out if quarantine is None else quarantine.unionByName(out)
    return served.where(F.coalesce(admitted, F.lit(False))), held.withColumn("_k", entry_key(held)).dropDuplicates(["_k"]).drop("_k")


def restored(served: DataFrame, quarantine: DataFrame) -> DataFrame:
    """served with the rows of quarantine that it lacks."""
    have = served.select(entry_key(served).alias("_k")).distinct()
    back = quarantine.withColumn("_k", entry_key(quarantine)).dropDuplicates(["_k"]).join(have, "_k", "left_anti").drop("_k")
    return served.unionByName(back.select(served.columns))


def merged_chapters(primary: DataFrame, others: DataFrame, existing: DataFrame, most: int = 1200) -> DataFrame:
    """Entries (book, chapter, author, work, tradition, year, verse_start, text) of all inputs, long texts cut at a blank, in order of verse and year.

    The primary's lack of a tradition means Patristic. Existing entries stay if they belong
    to a work, or if their author has no new ones in the chapter.
    """
    fresh = primary.withColumn("tradition", F.coalesce("tradition", F.lit("Patristic"))).unionByName(others)
    cut = F.concat(F.regexp_replace(F.substring("text", 1, most), r"\s+\S*$", ""), F.lit("…"))
    fresh = fresh.withColumn("text", F.when(F.length("text") > most, cut).otherwise(F.col("text")))
    authors = fresh.select("book", "chapter", "author").distinct()
    stay = existing.where(F.col("work").isNotNull()).unionByName(existing.where(F.col("work").isNull()).join(authors, ["book", "chapter", "author"], "left_anti").select(existing.columns))
    every = stay.unionByName(fresh.select(stay.columns))
    place = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("verse_start", F.coalesce("year", F.lit(9999)), "author", "text"))
    return every.withColumn("place", place)


def excerpt_eligibility(sources: DataFrame, cohort: str = "published", truncated: bool = False) -> DataFrame:
    """(slug, source_type, eligible, reason) of sources (slug, source_type, status, url, in_manifest, quarantine, policy, manifest_url, forbidden_rows).

    The first reason against a source counts. A scan that did not read every row certifies nothing.
    """
    own, listed = forbidden_domain(F.col("url")), forbidden_domain(F.col("manifest_url"))
    against = (
        F.when(~F.col("status").eqNullSafe(F.lit(cohort)), "other cohort").when(~F.coalesce("in_manifest", F.lit(False)), "no manifest entry")
        .when(~_blank(F.col("quarantine")), "quarantined").when(F.col("policy") == "skip", "skipped by manifest")
        .when(listed.isNotNull(), F.concat(F.lit("manifest source "), listed)).when(own.isNotNull(), F.concat(F.lit("source "), own))
        .when(F.coalesce("forbidden_rows", F.lit(0)) > 0, "forbidden rows")
    )
    if truncated:
        against = F.concat(F.lit("scan truncated; was: "), F.coalesce(against, F.lit("eligible")))
    return sources.select("slug", "source_type", against.isNull().alias("eligible"), F.coalesce(against, F.lit("eligible")).alias("reason"))


def picked_excerpts(eligibility: DataFrame, most: int = 3) -> DataFrame:
    """(slug, source_type): the first eligible slug of each type, at most so many types in the order of their first slug."""
    first = eligibility.where("eligible").groupBy("source_type").agg(F.min("slug").alias("slug"))
    return first.orderBy("slug").limit(most).select("slug", "source_type")


def admitted_anchors(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors (author, url, ...) that may count, how many were dropped by which rule)."""
    why = F.when(vetoed(F.col("author")), "author").when(F.col("url").isNotNull() & forbidden_domain(F.col("url")).isNotNull(), "provenance")
    marked = anchors.withColumn("_why", why)
    return marked.where("_why is null").drop("_why"), marked.where("_why is not null").groupBy(F.col("_why").alias("rule")).agg(F.count("*").alias("n"))


def defect_share(rows: DataFrame, group: str, pattern: str, text: str = "text", k: int = 25) -> DataFrame:
    """(group, n, n_bad, share) of the k groups with the largest share of rows that fit a pattern."""
    bad = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    n = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    return n.withColumn("share", F.col("n_bad") / F.col("n")).orderBy(F.desc("share"), group).limit(k)


def ends_and_marks(rows: DataFrame, group: str, order: str, mark: Column, k: int = 10) -> DataFrame:
    """Rows that are among the first or last k of their group, or carry a mark, with `where`: head, tail or mark. One pass keeps k rows a group before the shuffle."""
    head = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= k).drop("_n").withColumn("where", F.lit("head"))
    tail = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_n") <= k).drop("_n").withColumn("where", F.lit("tail"))
    return head.unionByName(tail).unionByName(rows.where(mark).withColumn("where", F.lit("mark")))


def clean_rows(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.where(clean_provenance(F.col(url)))
