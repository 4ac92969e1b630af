"""Full-text search as users type it: quoted phrases, OR, -term; ranks and marked excerpts.

Words are runs of a-z and 0-9 ("simple"), or those words' English stems ("english").
A question becomes a tree that is evaluated with column functions on the places of its
terms: documents without a needed word leave before they are cut into words. Ranks
are column functions too; excerpts are made for a page of results only.

Ranks follow what the documentation of common SQL text search says of them: rank()
adds each term's occurrences as 1, 1/4, 1/9, ... (for AND, instead, pairs of terms by
how near they are), cover_rank() adds covers, the shortest stretches that hold all terms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from corpusloom.functions.english import STOP_WORDS, stem, stems
from corpusloom.functions.text import tokens

WEIGHT = 0.1  # of a word that has none of its own
LIMIT = math.pi**2 / 6


@dataclass(frozen=True)
class Node:
    """op: term (words, one), phrase (words in a row), not, and, or."""

    op: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def terms(self) -> list[str]:
        """All different words that count for a rank: those not negated."""
        own = list(self.words) + [w for p in self.parts if p.op != "not" for w in p.terms()]
        return list(dict.fromkeys(own))


def _analysed(raw: str, config: str) -> list[str | None]:
    words = re.findall("[a-z0-9]+", raw.lower())
    return list(words) if config == "simple" else [None if w in STOP_WORDS else stem(w) for w in words]


def parsed(question: str, config: str = "simple") -> Node | None:
    """The tree of a question; None if no word is left. Nothing that is typed is an error."""
    any_of: list[list[Node]] = [[]]
    for m in re.finditer(r'(-)?(?:"([^"]*)"?|([^\s"]+))', question):
        if m[3] is not None and m[3].lower() == "or" and not m[1]:
            any_of.append([])
            continue
        words = [w for w in _analysed(m[2] if m[3] is None else m[3], config) if w]
        if not words:
            continue
        node = Node("term", (words[0],)) if len(words) == 1 else Node("phrase", tuple(words))
        any_of[-1].append(Node("not", parts=(node,)) if m[1] else node)
    sides = [side[0] if len(side) == 1 else Node("and", parts=tuple(side)) for side in any_of if side]
    if not sides:
        return None
    return sides[0] if len(sides) == 1 else Node("or", parts=tuple(sides))


def plain(question: str, config: str = "simple") -> Node | None:
    """The tree of plain words, all of which must occur."""
    words = list(dict.fromkeys(w for w in _analysed(question, config) if w))
    return None if not words else Node("term", (words[0],)) if len(words) == 1 else Node("and", parts=tuple(Node("term", (w,)) for w in words))


def needed(node: Node) -> list[str]:
    """Words that each match holds."""
    if node.op in ("term", "phrase"):
        return list(node.words)
    return [w for p in node.parts for w in needed(p)] if node.op == "and" else []


def holds(words: Column, node: Node) -> Column:
    """Whether words (nulls are words left out) fit the tree."""
    if node.op == "term":
        return F.coalesce(F.array_contains(words, node.words[0]), F.lit(False))  # null is a word left out, not a perhaps
    if node.op == "phrase":
        row = F.concat(F.lit(" "), F.array_join(words, " ", "?"), F.lit(" "))
        return F.contains(row, F.lit(f" {' '.join(node.words)} "))
    if node.op == "not":
        return ~holds(words, node.parts[0])
    out = holds(words, node.parts[0])
    for p in node.parts[1:]:
        out = out & holds(words, p) if node.op == "and" else out | holds(words, p)
    return out


def matches(docs: DataFrame, question: str | Node, config: str = "simple", text: str = "text") -> DataFrame:
    """docs that fit, with column words; none if no word is left of the question."""
    node = parsed(question, config) if isinstance(question, str) else question
    if node is None:
        return docs.withColumn("words", tokens(F.col(text))).where(F.lit(False))
    for term in needed(node):
        # A stem's letters, but for a last y or i, stand in every word that has it.
        begins = term if config == "simple" else term[:-1] if term[-1] in "iy" else term
        docs = docs.where(F.contains(F.lower(text), F.lit(begins)))
    w = docs.withColumn("words", tokens(F.col(text)))
    if config == "english":
        w = w.withColumn("words", F.coalesce(stems("words"), F.array().cast("array<string>")))
    return w.where(holds(F.col("words"), node))


def places(words: Column, term: str) -> Column:
    """Places of a term, from 1."""
    found = F.transform(words, lambda w, i: F.when(w == term, i + 1))
    return F.array_compact(found)


Places = Callable[[str], Column]  # of a term, ascending from 1; none where it is missing


def _or_rank(at: Places, terms: list[str]) -> Column:
    """For each term its weight times the sum of 1, 1/4, 1/9, ... over its occurrences, of the sum of all such; their mean."""
    n = lambda t: F.size(at(t))
    part = lambda t: F.when(n(t) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n(t), F.lit(1))), F.lit(0.0), lambda s, j: s + WEIGHT / (j * j).cast("double")) / LIMIT).otherwise(0.0)
    return sum((part(t) for t in terms), F.lit(0.0)) / len(terms)


def _nearness(distance: Column) -> Column:
    return F.when(distance > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def _and_rank(at: Places, terms: list[str]) -> Column:
    """1 less the product of what all pairs of places of two terms leave over."""

    def apart(a: str, b: str) -> Column:
        pairs = F.flatten(F.transform(at(a), lambda p: F.transform(at(b), lambda q: F.abs(p - q).cast("double"))))
        return F.aggregate(pairs, F.lit(1.0), lambda left, d: left * (1 - F.sqrt(WEIGHT * WEIGHT * _nearness(d))))

    left = F.lit(1.0)
    for i, a in enumerate(terms):
        for b in terms[:i]:
            left = left * apart(a, b)
    return F.when(left < 1, 1 - left).otherwise(1e-20)


def rank_at(at: Places, node: Node) -> Column:
    """How often, and for AND and phrases how near each other, the terms occur."""
    terms = node.terms()
    return _and_rank(at, terms) if node.op in ("and", "phrase") and len(terms) > 1 else _or_rank(at, terms)


def rank(words: Column, node: Node) -> Column:
    return rank_at(lambda t: places(words, t), node)


@F.pandas_udf(DoubleType())
def _covered(found: pd.Series, node: pd.Series) -> pd.Series:
    """Cover density from the places and numbers of terms, in order of place, and the tree's needs by number."""
    return pd.Series([cover_density([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in f], [list(map(set, side)) for side in n]) for f, n in zip(found, node, strict=True)])


def cover_density(found: list[tuple[int, int]], sides: list[list[set[int]]]) -> float:
    """found: (place, term) in order. sides: alternatives, each a list of sets of terms of which one at least must be in a cover."""
    total, begin = 0.0, 0
    fits = lambda have: any(all(have & need for need in side) for side in sides)
    while begin < len(found):
        have: set[int] = set()
        end = next((k for k in range(begin, len(found)) if fits(have := have | {found[k][1]})), None)
        if end is None:
            break
        have, start = set(), end
        for k in range(end, begin - 1, -1):
            have.add(found[k][1])
            if fits(have):
                start = k
                break
        noise = (found[end][0] - found[start][0]) - (end - start)
        total += WEIGHT / (1 + (noise if noise >= 0 else (end - start) / 2))
        begin = start + 1
    return total


def needs(node: Node, terms: list[str]) -> list[list[list[int]]]:
    """A tree's alternatives, each as sets of terms that a cover must meet; what is negated needs nothing."""
    if node.op == "or":
        return [side for p in node.parts for side in needs(p, terms)]
    if node.op == "and":
        out: list[list[list[int]]] = [[]]
        for p in node.parts:
            if p.op != "not":
                out = [a + b for a in out for b in needs(p, terms)]
        return out
    return [[[terms.index(w)] for w in node.words]]


def cover_rank_at(at: Places, node: Node) -> Column:
    """Sum over covers of the weight of a word, divided by one and the words in between."""
    terms = node.terms()
    named = lambda i: lambda p: F.struct(p.cast("int").alias("place"), F.lit(i).alias("term"))
    marked = [F.transform(at(t), named(i)) for i, t in enumerate(terms)]
    sides = F.array(*[F.array(*[F.array(*map(F.lit, need)) for need in side]) for side in needs(node, terms)])
    return _covered(F.array_sort(F.flatten(F.array(*marked))), sides)


def cover_rank(words: Column, node: Node) -> Column:
    return cover_rank_at(lambda t: places(words, t), node)


def excerpt(text: str, terms: list[str], config: str, least: int = 20, most: int = 50) -> str:
    """Words of the text around the densest terms, `least` to `most` of them, with every term in <mark>."""
    runs = list(re.finditer(r"\S+", text))
    hits = [any(w in terms for w in _analysed(r[0], config) if w) for r in runs]
    if not runs:
        return ""
    seen = [0]
    for h in hits:
        seen.append(seen[-1] + h)
    size = min(most, len(runs))
    # The window with most terms, the first of equals; then without what hangs over before its first and after its last term.
    begin = max(range(len(runs) - size + 1), key=lambda i: (seen[i + size] - seen[i], -i))
    end = begin + size
    inside = [i for i in range(begin, end) if hits[i]]
    if inside:
        begin, end = inside[0], min(len(runs), max(inside[-1] + 1, inside[0] + least))
        begin = max(0, min(begin, end - least))
    marked = [re.sub(r"[A-Za-z0-9]+", lambda m: f"<mark>{m[0]}</mark>" if any(w in terms for w in _analysed(m[0], config) if w) else m[0], r[0]) if h else r[0] for r, h in zip(runs[begin:end], hits[begin:end], strict=True)]
    return " ".join(marked)


def headlines(page: DataFrame, node: Node, config: str = "simple", text: str = "text", most: int = 50) -> DataFrame:
    """page with snippet; call it on the rows that are shown, after ranking and paging."""
    terms = node.terms()

    @F.pandas_udf(StringType())
    def snippet(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: excerpt(t, terms, config, most=most), na_action="ignore")

    return page.withColumn("snippet", snippet(F.col(text)))
