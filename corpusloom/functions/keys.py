"""Keys and codes: places between places, source keys, masks, tagged words' codes, campaign parameters, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digits of a place, in their order as characters.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _checked(key: str) -> str:
    if not re.fullmatch("[0-9A-Za-z]+", key) or key.endswith("0"):
        raise ValueError(f"{key!r} is no place")
    return key


def between(a: str | None, b: str | None) -> str:
    """A place after a and before b (None: no bound), as a string that sorts so; it never ends in the least digit, so there is always room before it."""
    low, high = "" if a is None else _checked(a), None if b is None else _checked(b)
    if high is not None and low >= high:
        raise ValueError(f"{a!r} is not before {b!r}")
    out = ""
    while True:
        x = DIGITS.index(low[0]) if low else 0
        y = DIGITS.index(high[0]) if high is not None else len(DIGITS)
        if high is None and low and x < len(DIGITS) - 1:
            return out + DIGITS[x + 1]  # the next digit is after all that begins with this one
        if y - x > 1:
            return out + DIGITS[(x + y) // 2]
        out += DIGITS[x]
        # Equal digits keep both bounds; neighbouring ones leave room above the rest of the lower bound only.
        low, high = low[1:], high[1:] if high is not None and x == y else None


def after(last: str | None, n: int) -> list[str]:
    """n places in order, all after `last`."""
    out: list[str] = []
    for _ in range(n):
        last = between(last, None)
        out.append(last)
    return out


def told_apart(key: str, first: int, second: int) -> str:
    """The place with two more digits, for writers that found the same one; still within the same bounds."""
    return key + DIGITS[first % len(DIGITS)] + DIGITS[1 + second % (len(DIGITS) - 1)]


@F.pandas_udf(StringType())
def place_between(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([between(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def source_ordinal(key: Column) -> Column:
    """The ordinal of type:work:ordinal[.chunk], from 1; null for keys of any other form."""
    found = F.regexp_extract(key, r"^[^:]*:[^:]*:([0-9]+)(?:\.[0-9]+)?$", 1)
    number = F.when((found != "") & (F.length(found) <= 15), found.cast("long"))
    return F.when(number >= 1, number)


def source_key(kind: Column, work: Column, *parts: Column) -> Column:
    """A key from its parts: the work in lower case with single hyphens for all but letters and digits."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(work), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat_ws(":", kind, slug, *[p.cast("string") for p in parts])


def key_parts(key: Column) -> tuple[Column, Column]:
    """(ordinal, chunk) of type:work:ordinal[.chunk] as numbers, for sorting; chunk 0 where there is none."""
    last = F.element_at(F.split(key, ":"), -1)
    part = lambda i: F.split_part(last, F.lit("."), F.lit(i))
    return F.nullif(part(1), F.lit("")).try_cast("long"), F.coalesce(F.nullif(part(2), F.lit("")).try_cast("long"), F.lit(0))


def mask_of(names: Column, all_names: list[str]) -> Column:
    """A mask with a bit for each of all_names (63 at most) that the array of names holds."""
    bits = [F.when(F.array_contains(names, n), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, n in enumerate(all_names)]
    out = F.lit(0).cast("long")
    for b in bits:
        out = out.bitwiseOR(b)
    return out


def mask_has(mask: Column, name: str, all_names: list[str]) -> Column:
    return mask.bitwiseAND(F.lit(1 << all_names.index(name)).cast("long")) != 0


def mask_names(mask: Column, all_names: list[str]) -> Column:
    """The names that a mask stands for."""
    return F.array_compact(F.array(*[F.when(mask_has(mask, n, all_names), F.lit(n)) for n in all_names]))


# ---- codes of tagged words

# What the letters of the codes mean, by place.
_GREEK = [
    {"1": "1st person", "2": "2nd person", "3": "3rd person"},
    {"P": "present", "I": "imperfect", "F": "future", "A": "aorist", "X": "perfect", "Y": "pluperfect"},
    {"A": "active", "M": "middle", "P": "passive"},
    {"I": "indicative", "D": "imperative", "S": "subjunctive", "O": "optative", "N": "infinitive", "P": "participle"},
    {"N": "nominative", "G": "genitive", "D": "dative", "A": "accusative", "V": "vocative"},
    {"S": "singular", "P": "plural"},
    {"M": "masculine", "F": "feminine", "N": "neuter"},
    {"C": "comparative", "S": "superlative"},
]
_GREEK_KINDS = {
    "N-": "noun", "A-": "adjective", "RA": "article", "RP": "personal pronoun", "RR": "relative pronoun", "RD": "demonstrative pronoun", "RI": "interrogative/indefinite pronoun",
    "V-": "verb", "P-": "preposition", "C-": "conjunction", "D-": "adverb", "X-": "particle", "I-": "interjection", "M-": "indeclinable number",
}
_HEBREW_KINDS = {"A": "adjective", "C": "conjunction", "D": "adverb", "N": "noun", "P": "pronoun", "R": "preposition", "S": "suffix", "T": "particle", "V": "verb"}
_HEBREW_NOUNS = {"c": "common", "p": "proper", "g": "gentilic"}
_HEBREW_STEMS = {"q": "qal", "N": "niphal", "p": "piel", "P": "pual", "h": "hiphil", "H": "hophal", "t": "hithpael"}
_HEBREW_FORMS = {
    "p": "perfect", "i": "imperfect", "w": "waw-consecutive", "h": "cohortative", "j": "jussive", "v": "imperative",
    "a": "infinitive absolute", "c": "infinitive construct", "r": "participle", "s": "passive participle",
}
_HEBREW_GENDERS = {"m": "masculine", "f": "feminine", "b": "both", "c": "common"}
_HEBREW_NUMBERS = {"s": "singular", "p": "plural", "d": "dual"}
_HEBREW_STATES = {"a": "absolute", "c": "construct", "d": "determined"}


def _mapped(table: dict[str, str], letter: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), letter)


def greek_code(code: Column) -> Column:
    """Words for a code such as "V- 3AAI-S--": the kind, then what its letters say."""
    kind, letters = F.split_part(code, F.lit(" "), F.lit(1)), F.split_part(code, F.lit(" "), F.lit(2))
    said = F.concat_ws(" ", *[_mapped(table, F.substring(letters, i, 1)) for i, table in enumerate(_GREEK, 1)])
    return F.concat_ws(" · ", F.nullif(F.coalesce(_mapped(_GREEK_KINDS, kind), kind), F.lit("")), F.nullif(said, F.lit("")))


def hebrew_code(code: Column) -> Column:
    """Words for a code such as "HR/Ncfsa": each part's kind and what its letters say, joined by +."""

    def part(p: Column) -> Column:
        kind, rest = F.substring(p, 1, 1), F.split(F.substring(p, F.lit(3), F.length(p)), "")
        letter = lambda i: F.substring(p, i, 1)
        of = lambda tables, letters: F.array_join(F.array_compact(F.transform(letters, lambda c: F.coalesce(*[_mapped(t, c) for t in tables]))), " ")
        noun = F.concat_ws(" ", _mapped(_HEBREW_NOUNS, letter(2)), F.nullif(of([_HEBREW_GENDERS, _HEBREW_NUMBERS, _HEBREW_STATES], rest), F.lit("")))
        verb = F.concat_ws(" ", _mapped(_HEBREW_STEMS, letter(2)), _mapped(_HEBREW_FORMS, letter(3)), F.nullif(of([_HEBREW_GENDERS, _HEBREW_NUMBERS], F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))), F.lit("")))
        more = F.when(kind == "N", noun).when(kind == "V", verb)
        return F.concat_ws(" ", F.coalesce(_mapped(_HEBREW_KINDS, kind), kind), F.nullif(more, F.lit("")))

    parts = F.filter(F.split(F.regexp_replace(code, "^[HA]", ""), "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, part), " + ")


# ---- addresses and paragraphs

# Parameters of an address that are kept, and how many characters of a value.
CAMPAIGN = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "gclid", "gad_source", "fbclid", "msclkid", "twclid", "ttclid", "igshid", "li_fat_id", "rdt_cid", "mc_cid", "mc_eid",
)
MOST_VALUE = 200


def attribution(url: Column, referrer: Column | None = None, keys: Iterable[str] = CAMPAIGN) -> Column:
    """map<string, string> of the kept parameters, the landing path unless it is /, and the host that referred, if it is another one."""
    value = lambda k: F.nullif(F.substring(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), 1, MOST_VALUE), F.lit(""))
    pairs = [(k, value(k)) for k in keys]
    path = F.substring(F.try_parse_url(url, F.lit("PATH")), 1, MOST_VALUE)
    pairs.append(("landing_path", F.when(~path.isin("", "/"), path)))
    if referrer is not None:
        from_host = F.lower(F.try_parse_url(referrer, F.lit("HOST")))
        pairs.append(("referrer_host", F.when(~from_host.eqNullSafe(F.lower(F.try_parse_url(url, F.lit("HOST")))), F.substring(from_host, 1, 253))))
    every = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs])
    return F.map_from_entries(F.array_compact(every))


def paragraph_around(text: Column, match: Column) -> Column:
    """struct(start, end) of the paragraph that holds a match, whatever its case, from 0, end exclusive, without blanks around it.

    Paragraphs are parted by blank lines, or by line feeds where there are none. A match
    that isn't there is looked for by its first six words. Null without a match, or where the
    paragraph is all there is.
    """
    lowered, needle = F.lower(text), F.lower(F.regexp_replace(match, r"^\s+|\s+$", ""))
    head = F.array_join(F.slice(F.split(needle, r"\s+"), 1, 6), " ")
    found = F.instr(lowered, needle)
    again = F.when(F.length(head) >= 8, F.instr(lowered, head)).otherwise(0)
    at = F.when(needle != "", F.when(found > 0, found).otherwise(again)).otherwise(0)
    before, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    blank_line, feed = r"\n\s*\n", r"\n"

    def bounds(mark: str) -> Column:
        left = F.element_at(F.split(before, mark), -1)
        right = F.element_at(F.split(rest, mark), 1)
        whole_paragraph = F.concat(left, right)
        start = at - 1 - F.length(left)
        lead = F.length(whole_paragraph) - F.length(F.regexp_replace(whole_paragraph, r"^\s+", ""))
        solid = F.length(F.regexp_replace(whole_paragraph, r"^\s+|\s+$", ""))
        return F.struct((start + lead).cast("int").alias("start"), (start + lead + solid).cast("int").alias("end"))

    para = F.when(text.rlike(blank_line), bounds(blank_line)).when(text.rlike(feed), bounds(feed))
    everything = (para["start"] == 0) & (para["end"] == F.length(F.regexp_replace(text, r"\s+$", "")))
    return F.when((at > 0) & para.isNotNull() & (para["end"] > para["start"]) & ~everything, para)
