"""English words for full-text search: the Snowball stemmer for English, and common words that are left out.

The stemmer follows the published description of the algorithm ("Porter2"). It runs in
Arrow batches and keeps what it found for words seen before, as words repeat.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that an English text search leaves out.
STOP_WORDS = frozenset(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()
)
# Words with stems of their own, and words that stay as they are after the first steps.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings and what takes their place, in the algorithm's second, third and fourth step; the longest that fits is meant.
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_VOWEL = "[aeiouy]"


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and second vowel with a consonant after it begin."""

    def after(at: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(word, at)
        return m.end() if m else len(word)

    head = re.match("gener|commun|arsen", word)
    first = head.end() if head else after(0)
    return first, after(first)


def _short_end(word: str) -> bool:
    return re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word) is not None


def _longest(word: str, endings: object) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)  # y is a consonant there
    first, second = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _DONE:
        return w
    # Past tenses and participles.
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= first:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(_VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short_end(w) and first >= len(w):
            w += "e"
    w = re.sub(r"(?<=[^aeiouy])(?<!^)[yY]$", "i", w) if len(w) > 2 else w
    ending = _longest(w, _SECOND)
    if ending and len(w) - len(ending) >= first:
        before = w[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before.endswith(tuple("cdeghkmnrt"))):
            w = before + _SECOND[ending]
    ending = _longest(w, _THIRD)
    if ending and len(w) - len(ending) >= (second if ending == "ative" else first):
        w = w[: -len(ending)] + _THIRD[ending]
    ending = _longest(w, _FOURTH)
    if ending and len(w) - len(ending) >= second and (ending != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e"):
        if len(w) - 1 >= second or (len(w) - 1 >= first and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of each row's words, null where a word is left out, so that places stay."""
    return pd.Series([None if ws is None else [None if w in STOP_WORDS else stem(w) for w in ws] for ws in words], dtype=object)
