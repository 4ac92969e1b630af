"""Text made comparable: entities decoded, compatibility forms, punctuation and blanks folded.

Spark has no NFKD, so these two go through Arrow batches; call them on rows that
are compared only, after filters and joins. Lengths are in code points.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The named entities that are decoded; other names stay as they are.
NAMES = """
amp lt gt quot apos nbsp ensp emsp thinsp shy zwnj zwj ndash mdash minus hellip lsquo rsquo sbquo ldquo rdquo bdquo
laquo raquo lsaquo rsaquo prime Prime copy reg trade deg sect para middot bull dagger Dagger
agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml ntilde
ograve oacute ocirc otilde ouml oslash ugrave uacute ucirc uuml yacute yuml szlig
""".split()
# Entities that stand for a plain blank, and for nothing.
BLANK, NOTHING = ("nbsp", "ensp", "emsp", "thinsp"), ("shy", "zwnj", "zwj")
ENTITY = {n: " " if n in BLANK else "" if n in NOTHING else html.unescape(f"&{n};") for n in NAMES}
_ROWS = 128
# Marks that count as blanks.
MARKS = re.compile(r"""[‘’“”'".,;:!?()\[\]{}–—…-]""")


def decoded(text: str) -> str:
    """Numeric entities and those of NAMES as characters; a name is looked up as written, then in lower case. Numbers of no character stay."""

    def one(m: re.Match[str]) -> str:
        if not m[1].startswith("#"):
            return ENTITY.get(m[1], ENTITY.get(m[1].lower(), m[0]))
        digits = m[1].lstrip("#xX").lstrip("0")
        if len(digits) > 8:
            return m[0]
        code = int(digits or "0", 16 if m[1][1] in "xX" else 10)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);", one, text)


def normal(text: str) -> str:
    return " ".join(MARKS.sub(" ", unicodedata.normalize("NFKD", decoded(text)).lower()).split())


def snapped(quote: str, body: str, least: int = 40, share: float = 0.4) -> str | None:
    """The quote if the body holds it; else its longest prefix of whole words that the body holds, if long enough."""
    within, whole = normal(body), normal(quote)
    if whole and whole in within:
        return quote
    words = [m.end() for m in re.finditer(r"\S+", quote)]
    low, high = 0, len(words)  # a prefix of a held prefix is held, so its length can be bisected
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if normal(quote[: words[middle - 1]]) in within else (low, middle - 1)
    if not low:
        return None
    kept = quote[: words[low - 1]].strip()
    size = len(normal(kept))
    return kept if size >= least and size >= share * len(whole) else None


def _by_rows(f: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """f of each row, null where a column is. A batch may have megabytes of text, so only a few rows at a time are Python strings."""
    parts = [pa.array([], pa.string())]
    for at in range(0, len(columns[0]), _ROWS):
        rows = zip(*[c.slice(at, _ROWS).to_pylist() for c in columns], strict=True)
        parts.append(pa.array([None if None in row else f(*row) for row in rows], pa.string()))
    return pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def normalized(text: pa.Array) -> pa.Array:
    """normal() of each text; null stays null."""
    return _by_rows(normal, text)


@F.arrow_udf(StringType())
def snapped_quote(quote: pa.Array, body: pa.Array) -> pa.Array:
    """snapped() of each pair; null where either is null or no prefix is long enough."""
    return _by_rows(snapped, quote, body)
