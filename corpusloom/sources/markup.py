"""Marked-up and scanned works as sections: ThML, TEI, plain ebooks, scanned lexicons, lexicon files, tagged originals.

A file is one work or book and is read as a whole by one task; its rules are
sequential, so they are plain Python over one text. `read_files` deals the files
out, keeps those that fail with their reason, and is all that Spark sees.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import references
from corpusloom.functions.normalize import decoded

Parser = Callable[[bytes], Iterable[tuple]]


def read_files(spark: SparkSession, path: str, parser: Parser, schema: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the file they are from, files that can't be read with the reason). parser gives a file's rows, as the schema says."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows, reason = [json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False) for r in parser(content)], None
                except Exception as fault:  # a file of another form must not stop the others
                    rows, reason = [], f"{type(fault).__name__}: {fault}"
                yield pa.RecordBatch.from_pydict({"file": [file] * max(1, len(rows)), "row": rows or [None], "reason": [reason] * max(1, len(rows))}, pa.schema([("file", pa.string()), ("row", pa.string()), ("reason", pa.string())]))

    read = files.mapInArrow(run, "file string, row string, reason string")
    rows = read.where("row is not null").select("file", F.from_json("row", schema).alias("r")).select("file", "r.*")
    return rows, read.where("reason is not null").select("file", "reason")


def roman(numeral: str) -> int | None:
    """Value of a Roman numeral in any case; None for other text."""
    worth = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    values = [worth.get(c) for c in numeral.lower()]
    if not values or None in values:
        return None
    return sum(-v if v < n else v for v, n in zip(values, [*values[1:], 0], strict=True)) or None


def tidy(text: str) -> str:
    """Blanks folded within lines, none at their ends, at most one blank line; words on two lines never fall together."""
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"^ | $", "", text, flags=re.MULTILINE)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# ---- trees of divisions


@dataclass
class Division:
    name: str
    attrs: dict[str, str]
    begin: int  # places in the events
    end: int = 0


@dataclass
class Markup(HTMLParser):
    """The events of a marked-up text: ("open", name, attrs), ("close", name, {}) and ("text", words, {}), entities decoded."""

    events: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.events.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("close", tag, {}))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, {}))


def events_of(text: str) -> list[tuple[str, str, dict[str, str]]]:
    m = Markup()
    m.feed(text)
    m.close()
    return m.events


def divisions(events: list[tuple[str, str, dict[str, str]]], names: tuple[str, ...]) -> list[Division]:
    """Elements of some names in the order in which they open, each with where it closes (the end, if it doesn't)."""
    found: list[Division] = []
    open_: list[Division] = []
    for i, (kind, name, attrs) in enumerate(events):
        if name not in names:
            continue
        if kind == "open":
            open_.append(Division(name, attrs, i, len(events)))
            found.append(open_[-1])
        elif kind == "close" and (mine := next((d for d in reversed(open_) if d.name == name), None)):
            mine.end = i
            open_.remove(mine)
    return found


def thml_text(events: list[tuple[str, str, dict[str, str]]]) -> str:
    """Readable text: verse lines keep their ends, notes go, words of references stay."""
    out: list[str] = []
    notes = 0
    for kind, name, _ in events:
        if name == "note" and kind != "text":
            notes += 1 if kind == "open" else -1
            out.append(" ")
        elif notes > 0:
            continue
        elif kind == "text":
            out.append(name)
        elif name in ("l", "verse"):
            out.append("\n" if kind == "close" else "")
        elif name != "scripref":
            out.append(" ")
    return tidy("".join(out))


# Kinds of divisions that are units, in order of preference, and headings of what is no part of a work.
UNITS = ("Hymn", "Sermon", "Poem", "chapter", "section", "Chapter", "Section", "part")
MATTER = re.compile(
    r"(title pages?|preface|introduction|index(es)? (of|to)|indexes$|index$|contents|table of|dedication|advertisement|to the reader|appendix|copyright|greek words|hebrew words|bibliograph)",
    re.IGNORECASE,
)
LEVELS = ("div1", "div2", "div3", "div4")


def _reference_of(events: list[tuple[str, str, dict[str, str]]]) -> tuple[int, int] | None:
    """The place that a unit's first reference names, by its osisRef or else its passage."""
    attrs = next((a for kind, name, a in events if kind == "open" and name == "scripref"), None)
    if attrs is None:
        return None
    asked = []
    point = r"(?:Bible(?:\.[A-Za-z0-9]+)?:)?([A-Za-z0-9]+)\.(\d+)\.(\d+)"
    if m := re.match(rf"{point}(?:-{point})?", attrs.get("osisref", ""), re.IGNORECASE):
        asked.append(f"{m[1]} {m[2]}:{m[3]}" + (f"-{m[5]}:{m[6]}" if m[4] else ""))
    if attrs.get("passage"):
        asked.append(attrs["passage"])
    for ref in asked:
        got = references.read(re.sub(r"^([1-3])\s*", r"\1 ", ref.lower()))
        if isinstance(got, references.Reference):
            return got.ranges[0]
    return None


def _psalm_of(heading: str) -> tuple[int, int] | None:
    m = re.search(r"\bPsalms?\s+(\d{1,3}|[IVXLCivxlc]{1,8})\b", heading)
    n = (int(m[1]) if m[1].isdigit() else roman(m[1])) if m else None
    return (references.place(19, n, 1), references.place(19, n, references.LAST_VERSE)) if n and n <= 150 else None


def _own_chapter(heading: str, book: int) -> tuple[int, int] | None:
    m = re.search(r"\bChapter\s+(\d{1,3})(?:\s+Verses?\s+(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?)?", heading, re.IGNORECASE)
    if not m or not int(m[1]):
        return None
    if m[2] is None:
        return references.place(book, int(m[1]), 1), references.place(book, int(m[1]), references.LAST_VERSE)
    first, last = int(m[2]), int(m[3] or m[2])
    return (references.place(book, int(m[1]), first), references.place(book, int(m[1]), last)) if first and last >= first else None


def thml_sections(content: bytes, least_units: int = 3, only: str | None = None, book: int | None = None, allowed_matter: str | None = None) -> list[tuple[int, str | None, str, int | None, int | None]]:
    """(ordinal, heading, body, start, end) of a ThML work's units.

    Units are the divisions of the type or class that most have, else those with a title at the
    level that most have, each then up to the next titled one. With `book`, the work is on one book: its
    headings name chapters of it, and references to other books tie nothing.
    """
    events = events_of(content.decode("utf-8", "replace"))
    every = divisions(events, LEVELS)
    typed = [[d for d in every if d.attrs.get(a) == t] for a in ("type", "class") for t in UNITS]
    units = max(typed, key=len)
    if len(units) < least_units:
        titled = [d for d in every if d.attrs.get("title")]
        at_level = max(([d for d in titled if d.name == level] for level in ("div2", "div3", "div1")), key=len)
        if len(at_level) < least_units:
            return []
        starts = [d.begin for d in titled] + [len(events)]
        units = [Division(d.name, d.attrs, d.begin, n) for d, n in zip(titled, starts[1:], strict=True)]
    out: list[tuple[int, str | None, str, int | None, int | None]] = []
    for d in units:
        inner = events[d.begin + 1 : d.end]
        heads = divisions(inner, ("h1", "h2", "h3", "h4", "h5", "h6"))
        printed = " ".join(thml_text(inner[heads[0].begin : heads[0].end]).split()) if heads else ""
        heading = " ".join(d.attrs.get("title", "").split()) or printed
        if MATTER.match(heading):
            if not (allowed_matter and re.search(allowed_matter, heading, re.IGNORECASE)):
                continue
            heading = printed or heading
        body = thml_text(inner)
        if len(body) < 40 or (only and not re.search(only, heading, re.IGNORECASE)):
            continue
        named = _reference_of(inner)
        if book:
            at = _own_chapter(heading, book) or (named if named and named[0] // 1_000_000 == book else None)
        else:
            at = named or _psalm_of(heading)
        out.append((len(out) + 1, heading or None, body, *(at or (None, None))))
    return out


# ---- TEI: annotations by verse

# Words that name a book in its head, and the book; ordinals tell numbered ones apart.
_HEADS = {
    "GENESIS": 1, "EXODUS": 2, "LEVITICUS": 3, "NUMBERS": 4, "DEUTERONOMY": 5, "JOSHUA": 6, "JUDGES": 7, "RUTH": 8, "SAMUEL": 9, "KINGS": 11, "CHRONICLES": 13, "EZRA": 15, "NEHEMIAH": 16, "ESTHER": 17, "JOB": 18,
    "PSALMS": 19, "PROVERBS": 20, "ECCLESIASTES": 21, "CANTICLES": 22, "ISAIAH": 23, "JEREMIAH": 24, "LAMENTATIONS": 25, "EZEKIEL": 26, "DANIEL": 27, "HOSEA": 28, "JOEL": 29, "AMOS": 30, "OBADIAH": 31, "JONAH": 32, "MICAH": 33,
    "NAHUM": 34, "HABAKKUK": 35, "ZEPHANIAH": 36, "HAGGAI": 37, "ZECHARIAH": 38, "MALACHI": 39, "MATTHEW": 40, "MARK": 41, "LUKE": 42, "ACTS": 44, "ROMANS": 45, "CORINTHIANS": 46, "GALATIANS": 48, "EPHESIANS": 49, "PHILIPPIANS": 50,
    "COLOSSIANS": 51, "THESSALONIANS": 52, "TIMOTHY": 54, "TITUS": 56, "PHILEMON": 57, "HEBREWS": 58, "JAMES": 59, "PETER": 60, "JUDE": 65, "REVELATION": 66,
}


def book_of_head(head: str) -> int | None:
    words = re.sub("[^A-Z ]", " ", head.upper()).split()
    nth = 3 if {"THIRD", "III"} & set(words) else 2 if {"SECOND", "II"} & set(words) else 1
    if "REVELATION" in words:
        return 66
    if "JOHN" in words:
        return 61 + nth if "EPISTLE" in words or {"I", "II", "III"} & set(words) else 43
    numbered = ("SAMUEL", "KINGS", "CHRONICLES", "CORINTHIANS", "THESSALONIANS", "TIMOTHY", "PETER")
    found = next((w for w in reversed(words) if w in _HEADS), None)
    return None if found is None else _HEADS[found] + (nth - 1 if found in numbered and nth == 2 else 0)


def tei_annotations(content: bytes) -> list[tuple[int, str]]:
    """(verse_id, text) of the notes at a page's foot in a TEI volume of annotations, by the verse paragraph they hang on.

    Chapters come from heads; a book without a head for its first one, or with verse numbers that
    start again, gets the chapter that must have begun there. Gaps in the print are marked.
    """
    events = events_of(content.decode("utf-8", "replace"))
    books = [d for d in divisions(events, ("div",)) if d.attrs.get("type") in ("book", "biblical_commentary")]
    out: list[tuple[int, str]] = []
    for d, until in zip(books, [b.begin for b in books[1:]] + [len(events)], strict=True):
        inner = events[d.begin : until]
        heads = divisions(inner, ("head",))
        book = book_of_head(_tei_text(inner[heads[0].begin : heads[0].end])) if heads else None
        if book is None:
            continue
        chapter, expected, last, begun = 1, 1, 0, not any(_chapter_of(inner, h) for h in heads)
        marks = sorted([(h.begin, "head", h) for h in heads[1:]] + [(p.begin, "p", p) for p in divisions(inner, ("p",))], key=lambda m: m[0])
        for _, kind, part in marks:
            if kind == "head":
                if n := _chapter_of(inner, part):
                    chapter, expected, last, begun = n, 1, 0, True
                continue
            number = part.attrs.get("n", "")
            if part.attrs and not number.isdigit():
                continue
            if number and int(number) <= 2 and last >= int(number) + 3:
                chapter, last = chapter + 1, 0
            verse = int(number) if number else expected
            expected, last = verse + 1, int(number) if number else last
            notes = [n for n in divisions(inner[part.begin : part.end], ("note",)) if n.attrs.get("place") == "bottom"]
            text = " ".join(t for n in notes if (t := _tei_text(inner[part.begin + n.begin : part.begin + n.end])))
            if text and 0 < verse <= 200 and (begun or number):
                out.append((references.place(book, chapter, verse), text))
    return out


def _chapter_of(events: list[tuple[str, str, dict[str, str]]], head: Division) -> int | None:
    m = re.match(r"(?:CHAP|PSAL(?:M)?)[.,▪]?\s+([IVXLC]+|\d+)[.,]?", _tei_text(events[head.begin : head.end]).replace("▪ ", ""), re.IGNORECASE)
    return (int(m[1]) if m[1].isdigit() else roman(m[1])) if m else None


def _tei_text(events: list[tuple[str, str, dict[str, str]]]) -> str:
    out: list[str] = []
    gaps, join = 0, False
    for kind, name, attrs in events:
        if kind == "open" and name == "gap":
            out.append(" ⟨…⟩ ")
            gaps += 1
        elif kind == "close" and name == "gap":
            gaps -= 1
        elif kind == "open" and name == "g" and attrs.get("ref") == "char:EOLhyphen":
            join = True
        elif kind == "text" and not gaps:
            out.append(name.lstrip() if join else name)
            join = False
        elif name != "g":
            out.append(" ")
    return " ".join("".join(out).split())


# ---- plain ebooks

# Headings and words of what surrounds a work in an ebook.
_EBOOK_HEAD = re.compile(
    r"(transcriber|contents|table of|a table|list of books|index|preface|dedication|to the reader|footnotes?|notes\b|errata|colophon|appendix|glossary|memoir|introduction|editor|advertisement|title page|by the same|works by|also by|published by|price\b)",
    re.IGNORECASE,
)
_EBOOK_BODY = re.compile(r"published by|price\s+\d|\bcloth\b.{0,12}(morocco|bound|gilt)|project gutenberg|transcriber'?s? note|in the (first|second|third|fourth) book\.", re.IGNORECASE)


def ebook_body(text: str) -> str:
    """What stands between the marks of an ebook's start and end."""
    text = text.replace("\r\n", "\n")
    start, end = re.search(r"\*\*\* START OF [^\n]*\*\*\*", text), re.search(r"\*\*\* END OF [^\n]*\*\*\*", text)
    return text[start.end() if start else 0 : end.start() if end else len(text)]


def without_apparatus(lines: list[str]) -> list[str]:
    """Lines without bracketed notes, which may run over several."""
    out: list[str] = []
    inside = False
    for line in lines:
        t = line.strip()
        if inside or t.startswith("["):
            inside = not t.endswith("]")
        else:
            out.append(line)
    return out


def epigraph(head: str) -> tuple[int, int] | None:
    """The place that a unit's first lines name, numbers of chapters Roman or not."""
    as_digits = lambda m: f"{m[1].rstrip('.')} {roman(m[2])}:{m[3]}" if roman(m[2]) else m[0]
    first = " ".join(head.replace("_", "").split("\n")[:6])
    found = references.found_in(re.sub(r"\b([1-3]?\s?[A-Za-z]{3,}\.?)[\s,]+([ivxlc]{1,6})\.\s*(\d{1,3})", as_digits, first))
    return found[0].reference.ranges[0] if found else None


def ebook_sections(content: bytes, start: str | None = None, end: str | None = None, headings: list[str] | None = None, apparatus: bool = False, epigraphs: bool = True) -> list[tuple[int, str | None, str, int | None, int | None]]:
    """(ordinal, heading, body, start, end) of a plain ebook's units.

    start and end (patterns of whole lines) bound the part that counts; a bound that isn't there is an
    error. headings are patterns of the units' own lines, each expected after the one before;
    without them units are parted by two or more blank lines. Front and back matter is left out.
    """
    lines = ebook_body(content.decode("utf-8", "replace")).split("\n")

    def line_of(pattern: str, at: int) -> int:
        found = next((i for i in range(at, len(lines)) if re.search(pattern, lines[i])), None)
        if found is None:
            raise ValueError(f"no line fits {pattern!r}")
        return found

    first = line_of(start, 0) + 1 if start else 0
    last = line_of(end, first) if end else len(lines)
    lines = lines[first:last]
    units: list[tuple[str, list[str]]] = []
    if headings:
        at = [-1]
        for h in headings:
            at.append(line_of(h, at[-1] + 1))
        for begin, until in zip(at[1:], [*at[2:], len(lines)], strict=True):
            units.append((" ".join(lines[begin].replace("_", "").split()), lines[begin + 1 : until]))
    else:
        for block in re.split(r"\n\s*\n\s*\n+", "\n".join(lines)):
            own = [x.strip() for x in block.strip().split("\n") if x.strip()]
            if len(block.strip()) > 120:
                units.append((own[0][:120], own[1:] or own))
    out: list[tuple[int, str | None, str, int | None, int | None]] = []
    for heading, own in units:
        body = "\n".join(x.strip() for x in (without_apparatus(own) if apparatus else own) if x.strip())
        if len(body) < 40 or _EBOOK_HEAD.match(heading) or _EBOOK_BODY.search(f"{heading}\n{body}"[:400]):
            continue
        at_place = epigraph(f"{heading}\n{body}") if epigraphs else None
        out.append((len(out) + 1, heading or None, body, *(at_place or (None, None))))
    return out


# ---- scanned lexicons

# How scanned headwords begin, what follows them, and words that only begin a sentence.
_OPENS = re.compile(r"^[*\"'“‘&[(]{0,2}[A-Za-zÀ-ɏ&{£€@|)\]'’.-]{0,27}[A-Za-zÀ-ɏ]\s*[,([]")
_INFLECTED = re.compile(r"-[a-zà-ÿ@]{0,10}\s*[,;:.]|indecl|\b(?:6|7|9|4|76|70|17)\s*,")
_PROSE = frozenset(
    """the and of to in a is it for with as by on that this from or are at be was not but his which have has he they we you i so an its these those also
see cf who whom all one two their there when where used word words sense meaning thing things others hence acc gen dat absol plur sing pers aor fut impf pass mid act inf ptcp subj
impv opp equiv prop name freq prob un in- un-""".split()
)


def opens_entry(line: str) -> bool:
    first = re.split(r"[\s,(\[]", line, maxsplit=1)[0]
    return bool(_OPENS.match(line) and _INFLECTED.search(line[:70])) and re.sub("[^a-z]", "", first.lower()) not in _PROSE


def scanned_entries(content: bytes) -> list[tuple[int, str, str]]:
    """(ordinal, key, text) of a scanned lexicon whose page furniture is gone already."""
    lines = content.decode("utf-8", "replace").split("\n")
    starts = [i for i, x in enumerate(lines) if x and not x.startswith(" ") and opens_entry(x)]
    out: list[tuple[int, str, str]] = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        key = re.sub(r"^[*\"'“‘&\[(]+", "", re.split(r"[,(\[]", lines[a], maxsplit=1)[0]).strip()
        text = " ".join(decoded("\n".join(lines[a:b])).split())
        if key and len(text) >= 40:
            out.append((len(out) + 1, key, text))
    return out


# ---- lexicon files


def numbered_entries(index: str) -> dict[str, list[str]]:
    """Numbers of each lexicon entry, from an index of cross references in order."""
    found: dict[str, list[str]] = {}
    for kind, name, attrs in events_of(index):
        if kind == "open" and name == "xref" and attrs.get("bdb") and attrs.get("strong"):
            if not re.fullmatch(r"\d+|[a-z]", attrs["strong"]):
                raise ValueError(f"unexpected number {attrs['strong']!r}")
            own = found.setdefault(attrs["bdb"], [])
            own += [attrs["strong"]] if attrs["strong"] not in own else []
    return found


def hebrew_lexicon(content: bytes, index: str) -> list[tuple[str, str]]:
    """(key, text) of a lexicon in XML; keys have the entry's numbers, or its own id, and its headword, and are told apart by the id."""
    numbers, events = numbered_entries(index), events_of(content.decode("utf-8"))
    entries = divisions(events, ("entry",))
    rows: list[tuple[str, str, str]] = []
    for d in entries:
        inner = events[d.begin : d.end]
        words = divisions(inner, ("w",))
        drop = divisions(inner, ("status",))
        text = " ".join(" ".join(x for i, (kind, x, _) in enumerate(inner) if kind == "text" and not any(s.begin < i < s.end for s in drop)).split())
        word = " ".join("".join(x for kind, x, _ in inner[words[0].begin : words[0].end] if kind == "text").split()) if words else ""
        own = d.attrs.get("id")
        if not own or not word or not text or any(e.begin < d.begin < e.end for e in entries if e is not d):
            raise ValueError(f"entry {own!r} has no id, headword or text, or lies in another")
        base = "+".join(f"H{s}" for s in numbers[own]) if own in numbers else f"bdb:{own}"
        rows.append((f"{base} {word}", own, text))
    if len({own for _, own, _ in rows}) != len(rows):
        raise ValueError("an id repeats")
    keys = [k for k, _, _ in rows]
    return [(f"{k} [{own}]" if keys.count(k) > 1 else k, text) for k, own, text in rows]


def greek_lexicon(content: bytes, file: str = "") -> list[tuple[str, str]]:
    """(key, text) of a lexicon in Markdown: ### headword, a line with its number, paragraphs."""
    text = content.decode("utf-8").replace("\r\n", "\n")
    heads = list(re.finditer(r"^### (.+)$", text, re.MULTILINE))
    out: list[tuple[str, str]] = []
    for i, m in enumerate(heads):
        body = re.sub(r"^\s*\n", "", text[m.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)])
        number = re.match(r"`Strong's G(\d+)`[ \t]*(?:\n|$)", body)
        body = body[number.end() :] if number else body
        word = m[1].split(" — ")[0].strip()
        if word == "-":
            word = (x[1].strip() if (x := re.search(r"^- Original: (.+)$", body, re.MULTILINE)) else word)
        elif not re.search(r"[Ͱ-Ͽἀ-῿]", word) and (x := re.search(r"STRONGS NT \d+[a-z]?:\s+([Ͱ-Ͽἀ-῿]+(?: ?\(\d+\))?)", body)):
            word = x[1]
        body = tidy(re.sub(r"^---\s*$", "", decoded(body), flags=re.MULTILINE))
        if not body:
            raise ValueError(f"{word!r} has no text")
        out.append((f"{f'G{number[1]}' if number else f'thayer:{file}:{i + 1}'} {unicodedata.normalize('NFC', word)}", body))
    if len({k for k, _ in out}) != len(out):
        raise ValueError("a key repeats")
    return out


def number_dictionary(content: bytes) -> list[tuple[str, str, str, str, str, str, str]]:
    """(number, lemma, translit, pron, def, derivation, kjv) of a script file that assigns one object literal; read as data, never run."""
    text = content.decode("utf-8")
    body = text[text.index("{") : text.rindex("}") + 1]
    # A literal with keys bare or quoted and trailing commas, made strict; strings stay as they are.
    strict = re.sub(r'("(?:[^"\\]|\\.)*")|([{,]\s*)([A-Za-z_]\w*)(\s*:)|,(\s*[}\]])', lambda m: m[1] or (m[5] if m[3] is None else f'{m[2]}"{m[3]}"{m[4]}'), body)
    entries = json.loads(strict)
    get = lambda e, *names: next((e[n] for n in names if e.get(n) is not None), "")
    return [(k, get(e, "lemma"), get(e, "translit", "xlit"), get(e, "pron", "pronounce"), get(e, "strongs_def").strip(), get(e, "derivation").strip(), get(e, "kjv_def").strip()) for k, e in entries.items()]


# ---- tagged originals


def short_gloss(meaning: str, usage: str) -> str:
    """The first clause of a meaning, or else of the usage, without asides; cut at 40 characters."""
    clean = lambda s: re.sub(r"^[\W\d_]+", "", " ".join(re.sub(r"\([^)]*\)", " ", s).split()))
    first = re.split("[;,]", clean(meaning))[0].strip() or re.split("[;,]", clean(usage))[0].strip()
    return first if len(first) <= 42 else first[:40].strip() + "…"


Lexicon = dict[str, tuple[str, str, str, str]]
"""By number: lemma, transliteration, meaning, usage."""


def hebrew_words(content: bytes, lexicon: Lexicon) -> list[tuple[int, int, int, str, str, str, str, str, str]]:
    """(chapter, verse, position, w, l, tr, s, m, g) of a book in XML with a lemma and a code for each word."""
    events = events_of(content.decode("utf-8"))
    out = []
    for v in divisions(events, ("verse",)):
        m = re.fullmatch(r"[^.]+\.(\d+)\.(\d+)", v.attrs.get("osisid", ""))
        if not m:
            continue
        position = 0
        inner = events[v.begin : v.end]
        for w in divisions(inner, ("w",)):
            word = "".join(x for kind, x, _ in inner[w.begin : w.end] if kind == "text").replace("/", "").strip()
            if not word:
                continue
            digits = re.search(r"\d+", w.attrs.get("lemma", "").split("/")[-1])
            number = f"H{int(digits[0])}" if digits and 1 <= int(digits[0]) <= 8674 else ""  # higher ones mark forms
            lemma, tr, meaning, usage = lexicon.get(number, ("", "", "", ""))
            out.append((int(m[1]), int(m[2]), position, word, lemma, tr, number, w.attrs.get("morph", ""), short_gloss(meaning, usage) if number in lexicon else ""))
            position += 1
    return out


def greek_words(content: bytes, lexicon: Lexicon) -> list[tuple[int, int, int, str, str, str, str, str, str]]:
    """(chapter, verse, position, w, l, tr, s, m, g) of lines: place, kind, code, text, word, form, lemma."""
    numbers = {unicodedata.normalize("NFC", lemma): n for n, (lemma, *_) in lexicon.items()}
    out, last, position = [], None, 0
    for line in content.decode("utf-8").strip().split("\n"):
        p = line.split(" ")
        if len(p) < 7:
            continue
        at = int(p[0][2:4]), int(p[0][4:6])
        position, last = (position + 1 if at == last else 0), at
        number = numbers.get(unicodedata.normalize("NFC", p[6]), "")
        _, tr, meaning, usage = lexicon.get(number, ("", "", "", ""))
        out.append((*at, position, p[4], p[6], tr, number, f"{p[1]} {p[2]}".strip(), short_gloss(meaning, usage) if number else ""))
    return out
