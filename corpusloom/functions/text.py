"""Text expressions: tokens, shingles, snippets, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(text: Column) -> Column:
    """Lower case, numeric entities and tags blanked, everything but a-z and 0-9 as single blanks."""
    # The patterns.
    t = F.regexp_replace(F.lower(text), "&#x?[0-9a-f]+;", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Words of a-z and 0-9; none of an empty text."""
    t = folded(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def ocr_body(text: Column) -> Column:
    """Words hyphenated over a line end joined, lines of four or more capitals and no other letters left out."""
    # The pattern and the number of letters.
    joined = F.regexp_replace(text, r"([A-Za-z])-[ \t]*\r?\n[ \t]*([A-Za-z])", "$1$2")
    letters = lambda line: F.regexp_replace(line, "[^A-Za-z]", "")
    kept = F.filter(F.split(joined, r"\r?\n"), lambda line: ~((F.length(letters(line)) >= 4) & ~letters(line).rlike("[a-z]")))
    return F.array_join(kept, " ")


def ocr_tokens(text: Column) -> Column:
    """Words of scanned text, without page furniture and plain numbers."""
    return F.filter(tokens(ocr_body(text)), lambda t: ~t.rlike("^[0-9]+$"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body (or a lambda in it) reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, n: int) -> Column:
    """Different runs of n words, joined by blanks."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(let(words, of))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters' codes (ASCII text), as a non-negative long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def window_around(text: Column, needle: str, width: int = 280) -> Column:
    """`width` characters of the text around the first place of needle, whatever its case."""
    at = F.locate(needle.lower(), F.lower(text))
    begin = F.greatest(at - F.lit((width - len(needle)) // 2), F.lit(1))
    return F.substring(text, begin, F.lit(width))


def contains_literal(text: Column, needle: str) -> Column:
    """Whether the text holds needle, whatever its case; % and _ are ordinary characters."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def roman(numeral: Column) -> Column:
    """Value of a Roman numeral of letters IVXLCDM in either case; null for other text."""
    # The letters' worth.
    worth = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    values = F.transform(F.filter(F.split(F.upper(numeral), ""), lambda c: c != ""), lambda c: F.element_at(worth, c))
    pairs = F.arrays_zip(values.alias("v"), F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0))).alias("n"))
    total = F.aggregate(pairs, F.lit(0), lambda a, p: a + F.when(p["v"] < p["n"], -p["v"]).otherwise(p["v"]))
    return F.when(F.upper(numeral).rlike("^[IVXLCDM]+$"), total)


def stem_english(word: Column) -> Column:
    """A light suffix stemmer for older English; the first rule that fits is the only one applied."""
    # Suffixes in the order of looking, what takes their place, and the letters that a word must have more.
    rules = [("eth", "", 4), ("est", "", 4), ("ies", "y", 4), ("ing", "", 4), ("ed", "", 4), ("es", "", 3), ("s", "", 3)]
    out = F.when(F.lit(False), word)
    for suffix, put, least in rules:
        fits = word.endswith(suffix) & (F.length(word) > least)
        if suffix == "s":
            fits = fits & ~word.endswith("ss")
        out = out.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put)))
    return out.otherwise(word)
