"""Scripture references: read from a whole string, found in prose, carried on in lists, and named by passage.

Places are integers, book * 1,000,000 + chapter * 1000 + verse; a whole chapter ends at verse 999.
These are sequential rules over short strings, so they run in Arrow batches, each text on its
own; the columns at the end are what queries use.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

LAST_VERSE = 999

# Slug, name, chapters, and further short forms of each book, in order.
_SINGLE = """
gen|Genesis|50|gn ge
exo|Exodus|40|ex exod
lev|Leviticus|27|lv
num|Numbers|36|nm nu numb
deu|Deuteronomy|34|dt deut
jos|Joshua|24|josh jsh
jdg|Judges|21|judg jgs jdgs
rut|Ruth|4|ru rth
sa|Samuel|31 24|sam sm
ki|Kings|22 25|kgs kin
ch|Chronicles|29 36|chron chr
ezr|Ezra|10|
neh|Nehemiah|13|ne
est|Esther|10|esth
job|Job|42|jb
psa|Psalms|150|psalm ps pss psm
pro|Proverbs|31|prov prv pr
ecc|Ecclesiastes|12|eccl eccles ec
sng|Song of Songs|8|song sos canticles cant
isa|Isaiah|66|is
jer|Jeremiah|52|jr
lam|Lamentations|5|lm
ezk|Ezekiel|48|ezek eze
dan|Daniel|12|dn dnl
hos|Hosea|14|ho
jol|Joel|3|jl
amo|Amos|9|am
oba|Obadiah|1|obad ob
jon|Jonah|4|jnh
mic|Micah|7|mc
nam|Nahum|3|nah na
hab|Habakkuk|3|habak
zep|Zephaniah|3|zeph zp
hag|Haggai|2|hg
zec|Zechariah|14|zech zc
mal|Malachi|4|ml
mat|Matthew|28|matt mt
mrk|Mark|16|mk mr
luk|Luke|24|lk lu
jhn|John|21|jn joh
act|Acts|28|ac
rom|Romans|16|ro rm
co|Corinthians|16 13|cor
gal|Galatians|6|ga gl
eph|Ephesians|6|ep
php|Philippians|4|phil philip philipp
col|Colossians|4|cl
th|Thessalonians|5 3|thess thes
ti|Timothy|6 4|tim
tit|Titus|3|
phm|Philemon|1|philem phlm phlmn
heb|Hebrews|13|hebr
jas|James|5|jam jms
pe|Peter|5 3|pet pt
jn|John|5 1 1|jhn joh jo
jud|Jude|1|
rev|Revelation|22|revelations rv apoc apocalypse
"""
# Names of several words beside the book's own.
_LONG_NAMES = {"sng": ["song of solomon"]}


@dataclass(frozen=True)
class Book:
    number: int
    slug: str
    name: str
    chapters: int


def _table() -> tuple[list[Book], dict[str, Book]]:
    """All books in order, and each by its lower-case names; numbered books have a number before every form."""
    books: list[Book] = []
    names: dict[str, Book] = {}
    for line in _SINGLE.split("\n"):
        if not line:
            continue
        slug, name, chapters, more = line.split("|")
        counts = list(map(int, chapters.split()))
        forms = [name.lower(), *more.split(), *_LONG_NAMES.get(slug, [])]
        for i, n in enumerate(counts, 1):
            if len(counts) == 1:
                book = Book(len(books) + 1, slug, name, n)
                own = [slug, *forms]
            else:
                book = Book(len(books) + 1, f"{i}{slug}", f"{i} {name}", n)
                own = [f"{i}{slug}", *(f"{i} {f}" for f in [*forms, slug])]
            books.append(book)
            names.update(dict.fromkeys(own, book))
    return books, names


BOOKS, NAMES = _table()
BY_SLUG = {b.slug: b for b in BOOKS}
# Words and numerals for 1, 2 and 3.
ORDINALS = {"i": "1", "ii": "2", "iii": "3", "1st": "1", "2nd": "2", "3rd": "3", "first": "1", "second": "2", "third": "3"}
# Named groups of books, by first and last slug.
GROUPS = {
    "pentateuch": ("gen", "deu"), "gospels": ("mat", "jhn"), "minor-prophets": ("hos", "mal"), "wisdom-literature": ("job", "sng"),
    "pauline-epistles": ("rom", "phm"), "general-epistles": ("jas", "jud"), "whole-bible": ("gen", "rev"),
}


def group_books(key: str) -> list[Book]:
    """The books of a named group, in order; none of an unknown one."""
    if key not in GROUPS:
        return []
    first, last = (BY_SLUG[s].number for s in GROUPS[key])
    return BOOKS[first - 1 : last]


def place(book: int, chapter: int, verse: int) -> int:
    return book * 1_000_000 + chapter * 1000 + verse


def is_place(key: int) -> bool:
    """Whether a key names a book, one of its chapters and a verse from 1 on."""
    book, chapter, verse = key // 1_000_000, key // 1000 % 1000, key % 1000
    return 1 <= book <= len(BOOKS) and 1 <= chapter <= BOOKS[book - 1].chapters and verse >= 1


def written_place(key: int) -> str:
    """"John 3:16"; books of one chapter go without its number."""
    book = BOOKS[key // 1_000_000 - 1]
    return f"{book.name} {key % 1000}" if book.chapters == 1 else f"{book.name} {key // 1000 % 1000}:{key % 1000}"


def book_words(raw: str) -> str:
    """A book's name in comparable form: lower case, blanks for marks, digits for ordinals."""
    words = re.sub(r"[.\-_]", " ", raw.lower()).split()
    if len(words) > 1 and words[0] in ORDINALS:
        words[0] = ORDINALS[words[0]]
    name = re.sub(r"^([123])(?=[a-z])", r"\1 ", " ".join(words))
    if name not in NAMES:
        # A Roman numeral may be written onto the name, but only where that gives a known one.
        numeral = re.match(r"i{1,3}(?=[a-z])", name)
        apart = numeral and f"{ORDINALS[numeral[0]]} {name[numeral.end() :]}"
        if apart in NAMES:
            return apart
    return name


def _beginnings() -> tuple[dict[str, list[Book]], dict[str, list[Book]]]:
    """The books, in order, whose names begin with a string: with their number, and without it."""
    whole: dict[str, set[Book]] = {}
    bare: dict[str, set[Book]] = {}
    for name, book in NAMES.items():
        for end in range(1, len(name) + 1):
            whole.setdefault(name[:end], set()).add(book)
            if re.match("[123] ", name):
                bare.setdefault(name[2 : 2 + end], set()).add(book)
    ordered = lambda some: {begin: sorted(books, key=lambda b: b.number) for begin, books in some.items()}
    return ordered(whole), ordered(bare)


# Candidates in prose are many and mostly no books, so each is one look-up and no walk over all names.
_BEGIN, _BEGIN_BARE = _beginnings()


def books_called(raw: str) -> list[Book]:
    """The one book of that name, or else all whose names begin so, with or without their number."""
    name = book_words(raw)
    if name in NAMES:
        return [NAMES[name]]
    return _BEGIN.get(name) or (_BEGIN_BARE.get(name, []) if len(name) > 1 else [])


@dataclass(frozen=True)
class Span:
    """Chapters or verses as written: verse None for whole chapters, open for "ff"."""

    chapter: int
    verse: int | None = None
    last_chapter: int | None = None
    last_verse: int | None = None
    open: bool = False

    @property
    def end_chapter(self) -> int:
        return self.chapter if self.last_chapter is None else self.last_chapter


@dataclass(frozen=True)
class Reference:
    book: Book
    kind: str
    ranges: list[tuple[int, int]]
    display: str


@dataclass(frozen=True)
class Refusal:
    reason: str
    candidates: tuple[Book, ...] = ()


Counts = Callable[[int, int], int | None]
"""Verses of a chapter (book, chapter), where they are known."""

_HALVES = re.compile(r"((?:[1-3][\s.]*|(?:i{1,3}|1st|2nd|3rd|first|second|third)[\s.]+)?[a-z][a-z.\s]*?)\s*(\d.*)?", re.IGNORECASE | re.ASCII | re.DOTALL)
_SPAN = re.compile(r"(\d+)(?::(\d+))?(?:-(\d+)(?::(\d+))?)?")


def _span(raw: str, single: bool, before: Span | None) -> Span | None:
    """One part of a list of numbers; bare numbers are verses after a verse and in books of one chapter."""
    s = re.sub(r"(\d)\s*vv?\s*(?=\d)|(\d)\s*\.\s*(?=\d)|(\d) +(?=\d)", lambda m: (m[1] or m[2] or m[3]) + ":", raw)
    s = re.sub(r"\s+", "", s)
    onward = s.endswith("ff")
    m = _SPAN.fullmatch(re.sub(r"(\d)(?:ff|[a-d])(?![a-z0-9_])", r"\1", s))
    if m is None or (m[4] is not None and m[2] is None):
        return None
    a, b, c, d = (None if x is None else int(x) for x in m.groups())
    if b is not None:
        return Span(a, b, c if d is not None else None, d if d is not None else c, onward and c is None)
    if single or (before is not None and before.verse is not None):
        chapter = 1 if single else before.end_chapter
        return Span(chapter, a, None, c, onward and c is None)
    return Span(a, None, c)


def _fault(span: Span, book: Book, counts: Counts | None) -> str | None:
    for c in (span.chapter, span.end_chapter):
        if not 1 <= c <= book.chapters:
            return f"{book.name} has one chapter" if book.chapters == 1 else f"{book.name} has {book.chapters} chapters"
    for c, v in ((span.chapter, span.verse), (span.end_chapter, span.last_verse)):
        if v is None:
            continue
        if v < 1:
            return "Verse numbers start at 1"
        if v >= LAST_VERSE:
            return f"No verse {v}"
        known = counts(book.number, c) if counts else None
        if known is not None and v > known:
            return f"{book.name} {'' if book.chapters == 1 else f'{c} '}has {known} verses"
    if span.last_verse is not None and span.end_chapter == span.chapter and span.last_verse < span.verse:
        return f"Backwards range: {span.verse}-{span.last_verse}"
    if span.end_chapter < span.chapter:
        return f"Backwards chapter range: {span.chapter}-{span.last_chapter}"
    return None


def _ends(span: Span, book: Book, counts: Counts | None) -> tuple[int, int]:
    def last(chapter: int) -> int:
        known = counts(book.number, chapter) if counts else None
        return place(book.number, chapter, LAST_VERSE if known is None else known)

    start = place(book.number, span.chapter, span.verse or 1)
    if span.verse is None:
        return start, last(span.end_chapter)
    if span.open:
        return start, last(span.chapter)
    return start, start if span.last_verse is None else place(book.number, span.end_chapter, span.last_verse)


def _shown(spans: list[Span], book: Book) -> str:
    parts: list[str] = []
    at: int | None = None
    for s in spans:
        across = s.end_chapter != s.chapter
        if s.verse is None:
            part = f"{s.chapter}–{s.last_chapter}" if s.last_chapter is not None else str(s.chapter)
        else:
            part = str(s.verse)
            if book.chapters > 1 and (s.chapter != at or across):
                part = f"{s.chapter}:{part}"
            if s.open:
                part += "ff"
            elif s.last_verse is not None:
                part += f"–{s.end_chapter}:{s.last_verse}" if across else f"–{s.last_verse}"
        parts.append(part)
        at = s.end_chapter
    return f"{book.name} {', '.join(parts)}"


def read(text: str, counts: Counts | None = None) -> Reference | Refusal:
    """The reference that a whole string is, or why it is none; nothing is guessed."""
    return _read_again(text) if counts is None and len(text) <= 80 else _read(text, counts)


@lru_cache(maxsize=1 << 14)
def _read_again(text: str) -> Reference | Refusal:
    """Short candidates come again, in a text by several shapes and in others; a bounded number is remembered."""
    return _read(text, None)


def _read(text: str, counts: Counts | None) -> Reference | Refusal:
    trimmed = re.sub("[–—]", "-", text.strip())
    if not trimmed:
        return Refusal("Empty reference")
    halves = _HALVES.fullmatch(trimmed)
    if halves is None:
        return Refusal(f'Not a reference: "{text.strip()}"')
    called, numbers = halves[1].strip(), (halves[2] or "").strip().lower()
    books = books_called(called)
    if len(books) != 1:
        return Refusal(f'Ambiguous book: "{called}"', tuple(books)) if books else Refusal(f'Unknown book: "{called}"')
    book = books[0]
    if not numbers:
        whole = Span(1, None, book.chapters)
        return Reference(book, "book", [_ends(whole, book, counts)], book.name)
    spans: list[Span] = []
    for raw in numbers.split(","):
        if not raw.strip():
            return Refusal("Empty segment in sequence")
        span = _span(raw.strip(), book.chapters == 1, spans[-1] if spans else None)
        if span is None:
            return Refusal(f'Can\'t read "{raw.strip()}" as chapter and verse')
        spans.append(span)
    for span in spans:
        if fault := _fault(span, book, counts):
            return Refusal(fault)
    first = spans[0]
    if len(spans) > 1:
        kind = "sequence"
    elif first.verse is None:
        kind = "chapter" if first.last_chapter is None else "chapter_range"
    else:
        kind = "verse_range" if first.last_verse is not None or first.open else "verse"
    return Reference(book, kind, [_ends(s, book, counts) for s in spans], _shown(spans, book))


# ---- in prose


@dataclass(frozen=True)
class Found:
    reference: Reference
    start: int
    end: int
    word: str  # the book's name as it stands there, in lower case
    numbered: bool  # whether an ordinal stands before it


_NUMBERS = r"\d{1,3}(?::\d{1,3})?(?:\s*[-–]\s*\d{1,3}(?::\d{1,3})?)?"
_SPACED = r"\d{1,3}\s+\d{1,3}(?:\s*[-–]\s*\d{1,3}(?::\d{1,3})?)?"
_ORDINAL = r"[1-3]|i{1,3}|first|second|third"
_WORDS = "|".join(sorted((re.escape(n) for n in NAMES if " " in n and not re.match("[1-3] ", n)), key=len, reverse=True))
#: Shapes that candidates have: an ordinal (or none), a book's name and numbers.
_SHAPES = [
    re.compile(shape, re.IGNORECASE | re.ASCII)
    for shape in (
        rf"\b(?:({_ORDINAL})\s+)?([a-z]{{2,}})\s+({_NUMBERS})\b",
        rf"\b({_ORDINAL})\s+([a-z]{{2,}})\.?\s+({_NUMBERS})\b",
        rf"\b([1-3])([a-z]{{2,}})\.?\s+({_NUMBERS})\b",
        rf"\b(?:({_ORDINAL})\s+)?([a-z]{{2,}})\s+({_SPACED})\b",
        rf"\b()({_WORDS})\s+({_NUMBERS})\b",
    )
]


def found_in(text: str, counts: Counts | None = None) -> list[Found]:
    """References in prose, each once, in order. Every candidate has to be a whole reference; of overlapping ones the longest stays."""
    spots: list[Found] = []
    for shape in _SHAPES:
        for m in shape.finditer(text):
            got = read(" ".join(f"{m[1] or ''} {m[2]} {m[3]}".split()), counts)
            if isinstance(got, Reference):
                spots.append(Found(got, m.start(), m.end(), m[2].lower(), bool(m[1])))
    order = {id(s): (s.start - s.end, s.start, i) for i, s in enumerate(spots)}
    kept = [s for s in spots if not any(o.start < s.end and s.start < o.end and order[id(o)] < order[id(s)] for o in spots)]
    out: dict[str, Found] = {}
    for s in sorted(kept, key=lambda s: s.start):
        out.setdefault(s.reference.display, s)
    return list(out.values())


def is_explicit(display: str, body: str) -> bool:
    """Whether the book is named in the body with a number after it: digits, or a Roman numeral with a full stop."""
    word = re.sub(r"\s+[0-9].*$", "", display, flags=re.DOTALL).split()[-1:]
    return bool(word) and _cited(word[0][:3]).search(body) is not None


@lru_cache(maxsize=256)
def _cited(stem: str) -> re.Pattern[str]:
    return re.compile(rf"\b{re.escape(stem)}[a-z]*\.?\s+(?:[0-9]|[ivxlc]{{1,6}}\.)", re.IGNORECASE | re.ASCII)


# ---- lists that carry on


@dataclass(frozen=True)
class Listed:
    at: int
    length: int
    display: str
    start: int
    end: int


@dataclass(frozen=True)
class Missed:
    at: int
    token: str
    reason: str


_BLANK = "[  ]"
_PART = r"\d{1,3}(?::\d{1,3})?(?:-\d{1,3}(?![A-Za-z])(?::\d{1,3})?)?"
_OPENS = re.compile(rf"(?<![A-Za-z])((?:[123]{_BLANK}?)?[A-Za-z]{{2,8}})\.?{_BLANK}+({_PART})")
_GOES_ON = re.compile(rf"([;,]{_BLANK}*(?:with)?|{_BLANK}+with)?{_BLANK}*({_PART})(?![:\d])")
_NAME_NEXT = re.compile(rf"{_BLANK}*([A-Za-z]{{2,8}})\.?{_BLANK}+({_PART})")
# Words before numbers that name no book.
_PROSE = frozenset("with verse verses chapter chapters ver chap see also about compare".split())


def _resolved(book: str, part: str) -> tuple[int, int, int] | None:
    """(start, end, chapter of the start)."""
    got = read(f"{book} {part}")
    return (got.ranges[0][0], got.ranges[-1][1], got.ranges[0][0] // 1000 % 1000) if isinstance(got, Reference) else None


def _numbers_next_book(number: str, text: str, at: int) -> bool:
    """Whether a bare 1, 2 or 3 before this place belongs to a numbered book that follows."""
    if number not in ("1", "2", "3"):
        return False
    follows = _NAME_NEXT.match(text, at)
    return follows is not None and _resolved(number + follows[1], follows[2]) is not None


def listed(text: str) -> tuple[list[Listed], list[Missed]]:
    """References of a printed list, where later ones inherit book and chapter, and those whose book is known but not the place."""
    refs: list[Listed] = []
    missed: list[Missed] = []
    at = 0
    while m := _OPENS.search(text, at):
        word, part = m[1].strip(), m[2]
        at = m.start() + 1  # a word of prose may have eaten the digit of the next reference
        if word.lower() in _PROSE:
            continue
        book = "Judges" if word.lower() == "jud" else word  # as these lists abbreviate
        got = _resolved(book, part)
        if got is None:
            if _resolved(book, "1:1") or _resolved(book, "1"):
                why = read(f"{book} {part}")
                missed.append(Missed(m.start(), f"{word} {part}", why.reason if isinstance(why, Refusal) else "unresolvable"))
            continue
        if _numbers_next_book(part, text, m.end()):
            at = m.end() - len(part)
            continue
        refs.append(Listed(m.start(), m.end() - m.start(), f"{book} {part}", got[0], got[1]))
        chapter, at = got[2], m.end()
        while more := _GOES_ON.match(text, at):
            mark, part = (more[1] or "").strip(), more[2]
            if _numbers_next_book(part, text, more.end()):
                break
            # After a comma bare numbers are verses of the chapter at hand; after all else, chapters.
            full = f"{chapter}:{part}" if mark == "," and ":" not in part else part
            got = _resolved(book, full)
            if got is None:
                break
            refs.append(Listed(more.end() - len(part), len(part), f"{book} {full}", got[0], got[1]))
            chapter, at = got[2], more.end()
    return refs, missed


def labelled_entries(body: str) -> tuple[list[tuple[int, str | None, int, int]], list[str]]:
    """(ordinal, label, start, end) of a topic's references, and the tokens that weren't understood.

    A reference's label is what stands before the first one on its line, or else the nearest of
    the four lines above that has words and no references.
    """
    refs, missed = listed(body)
    lines = body.split("\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    by_line: dict[int, list[Listed]] = {}
    line = 0
    for r in sorted(refs, key=lambda r: r.at):
        while begins[line + 1] <= r.at:
            line += 1
        by_line.setdefault(line, []).append(r)

    def bare(s: str) -> str:
        return re.sub(r"[\s:;,]+$", "", re.sub(r"^[\s→\-–—.•(]+(\d+[.)]\s*)?", "", s)).strip()

    out: list[tuple[int, str | None, int, int]] = []
    for n, own in sorted(by_line.items()):
        label = bare(lines[n][: own[0].at - begins[n]])
        up = n - 1
        while not label and up >= max(0, n - 4) and up not in by_line:
            label, up = bare(lines[up]), up - 1
        out += [(len(out) + i, label[:200] or None, r.start, r.end) for i, r in enumerate(own, 1)]
    return out, [m.token for m in missed]


# ---- named passages

# Passages by the names they go by (of one passage, separated by commas), and where they are.
PASSAGES = """
sermon on the mount | Matthew 5-7
the beatitudes, beatitudes | Matthew 5:3-12; Luke 6:20-23
lords prayer, our father who art in heaven | Matthew 6:9-13; Luke 11:2-4
armor of god, armour of god, whole armor of god | Ephesians 6:10-18
ten commandments, decalogue | Exodus 20:1-17; Deuteronomy 5:6-21
good shepherd | John 10
the vine and the branches, vine and the branches | John 15
bread of life | John 6
prodigal son | Luke 15:11-32
good samaritan | Luke 10:25-37
road to emmaus | Luke 24:13-35
the transfiguration, transfiguration | Matthew 17:1-9; Mark 9:2-8; Luke 9:28-36
great commission | Matthew 28:16-20
the lords supper, lords supper, last supper | Matthew 26:26-29; Luke 22:14-20; 1 Corinthians 11:23-26
fruit of the spirit | Galatians 5:22-23
the love chapter, love chapter | 1 Corinthians 13
the ten virgins, wise and foolish virgins | Matthew 25:1-13
valley of dry bones | Ezekiel 37
the burning bush, burning bush | Exodus 3
golden calf | Exodus 32
the fiery furnace, fiery furnace | Daniel 3
lions den | Daniel 6
writing on the wall, mene mene tekel | Daniel 5
four horsemen | Revelation 6
new heaven and a new earth, new heaven and new earth | Revelation 21
pentecost, tongues of fire | Acts 2
raising of lazarus, lazarus | John 11
prophets of baal, mount carmel | 1 Kings 18
walking on water, walking on the water | Matthew 14:22-33; John 6:16-21
feeding of the five thousand, feeding the five thousand | Matthew 14:13-21; John 6:1-14
jacob wrestling, wrestling with god | Genesis 32
the crucifixion, crucifixion of jesus | Matthew 27; John 19
the empty tomb, resurrection of jesus | Matthew 28; John 20
"""
# Words that show that a question is about scripture, beside names of books.
_THEMES = """
gospel gospels epistle epistles god lord jesus christ messiah savior saviour holy spirit scripture scriptures bible biblical
verse verses passage chapter testament parable parables disciple disciples apostle apostles prophet prophets prophecy covenant
righteousness salvation sin sins sinner repentance grace faith faithful believe belief holiness heaven heavenly hell kingdom
resurrection risen raised raising rose crucified crucifixion cross atonement redemption redeemer sabbath temple synagogue church
priest pharisee pharisees gentile gentiles israel israelite israelites tongues angel angels miracle miracles blessed glory worship
preach sermon creation flood ark passover manna tabernacle sacrifice prayer baptism baptized communion trinity incarnation exile
babylon egypt jerusalem zion bethlehem nazareth galilee calvary
"""
_PEOPLE = """
moses aaron abraham sarah isaac jacob esau joseph noah adam eve cain abel david solomon saul elijah elisha shadrach meshach abednego
nebuchadnezzar pharaoh herod pilate paul peter andrew philip bartholomew thomas mary martha lazarus judas stephen barnabas cornelius
goliath samson gideon deborah boaz naaman zacchaeus nicodemus caiaphas
"""
_NOT_TELLING = {"of", "songs", "john"}
LEXICON = frozenset(_THEMES.split()) | frozenset(_PEOPLE.split()) | {"psalm"} | {w for b in BOOKS for w in b.name.lower().split() if not w.isdigit() and w not in _NOT_TELLING}
# Names of books that are common words.
COMMON_WORDS = frozenset(["mark", "james", "job", "acts", "numbers", "kings"])


def _ranges_of(refs: str) -> list[tuple[int, int]]:
    return [r for ref in refs.split(";") if isinstance(got := read(ref), Reference) for r in got.ranges]


_PASSAGES = [(names.strip().split(", "), _ranges_of(refs)) for names, _, refs in (line.partition("|") for line in PASSAGES.strip().split("\n"))]


def _plain(text: str) -> str:
    return f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "


def intent(question: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(named, certain): the ranges a question names, and those of them that are surely meant.

    Numbers are certain unless the book's name is a common word. Such ones, and named passages,
    need another word of scripture outside the match; a certain number also vouches for the
    former, another named passage for the latter.
    """
    spots = found_in(question)
    doubtful = [s for s in spots if s.word in COMMON_WORDS]
    sure = [s for s in spots if s.word not in COMMON_WORDS]
    rest = question
    for s in sorted(doubtful, key=lambda s: -s.start):
        rest = f"{rest[: s.start]} {rest[s.end :]}"
    vouched = bool(sure) or any(w in LEXICON for w in _plain(rest).split())
    named = [r for s in sure + doubtful for r in s.reference.ranges]
    certain = [r for s in sure + (doubtful if vouched else []) for r in s.reference.ranges]
    plain = _plain(question)
    passages = [(min(own, key=len), ranges) for names, ranges in _PASSAGES if (own := [n for n in names if f" {n} " in plain])]
    without = plain
    for name, _ in passages:
        without = without.replace(f" {name} ", " ")
    backed = len(passages) > 1 or any(w in LEXICON for w in without.split())
    for _, ranges in passages:
        named += ranges
        certain += ranges if backed else []
    return list(dict.fromkeys(named)), list(dict.fromkeys(certain))


# ---- years and dates

_YEARS = [
    (re.compile(r"\bA\.?\s?D\.?\s+(\d{1,4})\b", re.IGNORECASE | re.ASCII), 1),
    (re.compile(r"\b(\d{1,4})\s+B\.?\s?C\.?(?:E\.?)?(?![A-Za-z0-9_])", re.IGNORECASE | re.ASCII), -1),
    (re.compile(r"\b(\d{1,4})\s+C\.?E\.?(?![A-Za-z0-9_])", re.IGNORECASE | re.ASCII), 1),
]


def stated_years(text: str) -> tuple[int, int] | None:
    """The first and last year that a text states with an era; years before Christ are negative."""
    years = [sign * int(m[1]) for pattern, sign in _YEARS for m in pattern.finditer(text)]
    return (min(years), max(years)) if years else None


# Ordinals of centuries.
_CENTURIES = "first second third fourth fifth sixth seventh eighth ninth tenth".split()


def asked_years(question: str) -> tuple[int, int] | None:
    """A range of years after A.D., else all single years with an era, else a century in words."""
    m = re.search(r"\bA\.?D\.?\s*(\d{1,4})\s*(?:[-–]|to)\s*(\d{1,4})\b", question, re.IGNORECASE)
    if m:
        return int(m[1]), int(m[2])
    years = [int(y) for y in re.findall(r"\bA\.?D\.?\s*(\d{1,4})\b", question, re.IGNORECASE)]
    years += [-int(y) for y in re.findall(r"\b(\d{1,4})\s*B\.?C\.?(?![A-Za-z0-9_])", question, re.IGNORECASE)]
    if years:
        return min(years), max(years)
    m = re.search(rf"\b({'|'.join(_CENTURIES)})\s+century(\s+B\.?C\.?)?", question, re.IGNORECASE)
    if not m:
        return None
    n = _CENTURIES.index(m[1].lower()) + 1
    return (-100 * n, -100 * (n - 1) - 1) if m[2] else (100 * (n - 1) + 1, 100 * n)


# Labels that are looked for as whole words, by slug and kind.
GAZETTEER = """
herod-the-great person Herod
vespasian person Vespasian
titus person Titus
nero person Nero
pilate person Pilate
moses person Moses
abraham person Abraham
david person David
solomon person Solomon
antony person Antony
caesar person Caesar
agrippa person Agrippa
jerusalem place Jerusalem
galilee place Galilee
judea place Judea|Judaea
rome place Rome
egypt place Egypt
babylon place Babylon
masada place Masada
samaria place Samaria
antioch place Antioch
alexandria place Alexandria
the-temple institution the temple|the Temple
sanhedrin institution Sanhedrin
pharisees institution Pharisees
sadducees institution Sadducees
essenes institution Essenes
siege-of-jerusalem event siege of Jerusalem
constantine person Constantine
athanasius person Athanasius
arius person Arius
origen person Origen
polycarp person Polycarp
ignatius-of-antioch person Ignatius
diocletian person Diocletian
nicaea place Nicaea|Nice
council-of-nicaea event Council of Nicaea|Council of Nice
diocletian-persecution event Diocletian persecution
britain place Britain
saxons person Saxons
britons person Britons
picts person Picts
kent place Kent
canterbury place Canterbury
northumbria place Northumbria
mercia place Mercia
iona place Iona
lindisfarne place Lindisfarne
wilfrid person Wilfrid
cuthbert person Cuthbert
columba person Columba
easter-controversy event Easter controversy|Quartodeciman|Synod of Whitby
constantinople place Constantinople
chalcedon place Chalcedon
chrysostom person Chrysostom
jerome-of-stridon person Jerome
ambrose person Ambrose
donatists institution Donatists
arians institution Arians
charlemagne person Charlemagne
crusades event Crusade|Crusades
wycliffe person Wycliffe|Wiclif
huss person Huss
luther person Luther
melanchthon person Melanchthon
zwingli person Zwingli
calvin-john person Calvin
geneva place Geneva
wittenberg place Wittenberg
worms place Worms
huguenots person Huguenots
waldenses person Waldenses|Waldensians
anabaptists person Anabaptists
cranmer person Cranmer
latimer person Latimer
ridley person Ridley
wesley-john person Wesley
whitefield person Whitefield
asbury person Asbury
methodists institution Methodists
puritans person Puritans
"""
Vocabulary = list[tuple[str, str, list[str]]]
_GAZETTEER: Vocabulary = [(slug, kind, labels.split("|")) for slug, kind, labels in (line.split(" ", 2) for line in GAZETTEER.strip().split("\n"))]


def named_entities(text: Column, vocabulary: Vocabulary | None = None, any_case: bool = False) -> Column:
    """Slugs of the vocabulary whose label, or a further one, stands in the text as a whole word; without Python on the executors."""
    hit = lambda labels: text.rlike(("(?i)" if any_case else "") + r"\b(?:" + "|".join(re.escape(x) for x in labels) + r")\b")
    every = F.array(*[F.when(hit(labels), F.lit(slug)) for slug, _, labels in (_GAZETTEER if vocabulary is None else vocabulary)])
    return F.array_distinct(F.array_compact(every))


# Names of months, and the characters of a text that count as its head.
_MONTHS = "january february march april may june july august september october november december".split()
HEAD = 2000


def stated_date(head: Column) -> Column:
    """The first date with a month's name, day before or after it, as yyyy-MM-dd; null if it is no date. No Python is used."""
    months = "|".join(_MONTHS)
    day_first = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({months})\s*,?\s+(\d{{4}})\b"
    month_first = rf"(?i)\b({months})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})\b"
    at = lambda p: F.when(F.regexp_instr(head, F.lit(p)) > 0, F.regexp_instr(head, F.lit(p)))
    first = F.coalesce(at(day_first) <= at(month_first), at(day_first).isNotNull())
    take = lambda a, b: F.when(first, F.regexp_extract(head, day_first, a)).otherwise(F.regexp_extract(head, month_first, b))
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(take(2, 1)))
    found = F.concat_ws("-", F.lpad(take(3, 3), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(take(1, 2), 2, "0"))
    return F.when(month > 0, F.date_format(F.try_to_date(found, "yyyy-MM-dd"), "yyyy-MM-dd"))


# ---- columns

_RANGE = StructType([StructField("start", LongType()), StructField("end", LongType())])
_READ = StructType([StructField("ok", BooleanType()), StructField("display", StringType()), StructField("kind", StringType()), StructField("ranges", ArrayType(_RANGE)), StructField("reason", StringType())])
_FOUND = ArrayType(StructType([StructField("display", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("at", IntegerType()), StructField("explicit", BooleanType())]))
_LISTED = StructType([
    StructField("entries", ArrayType(StructType([StructField("ordinal", IntegerType()), StructField("label", StringType()), StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("missed", ArrayType(StringType())),
])
_INTENT = StructType([StructField("named", ArrayType(_RANGE)), StructField("certain", ArrayType(_RANGE))])


def _each(texts: pd.Series, f: Callable[[str], object]) -> Iterator[object]:
    return (None if t is None else f(t) for t in texts)


@F.pandas_udf(_READ)
def reference(text: pd.Series) -> pd.DataFrame:
    """read() of each text."""

    def row(t: str) -> tuple:
        got = read(t)
        if isinstance(got, Refusal):
            return False, None, None, None, got.reason
        return True, got.display, got.kind, [{"start": a, "end": b} for a, b in got.ranges], None

    return pd.DataFrame([r or (None,) * 5 for r in _each(text, row)], columns=_READ.names)


@F.pandas_udf(_FOUND)
def references(text: pd.Series) -> pd.Series:
    """A row for each range of found_in(), with whether the citation is explicit."""

    def rows(t: str) -> list[dict]:
        return [{"display": s.reference.display, "start": a, "end": b, "at": s.start, "explicit": is_explicit(s.reference.display, t)} for s in found_in(t) for a, b in s.reference.ranges]

    return pd.Series(list(_each(text, rows)), dtype=object)


@F.pandas_udf(_LISTED)
def topic_entries(body: pd.Series) -> pd.DataFrame:
    """labelled_entries() of each text."""

    def row(t: str) -> tuple:
        entries, missed = labelled_entries(t)
        return [dict(zip(("ordinal", "label", "start", "end"), e, strict=True)) for e in entries], missed

    return pd.DataFrame([r or (None, None) for r in _each(body, row)], columns=_LISTED.names)


@F.pandas_udf(_INTENT)
def question_intent(question: pd.Series) -> pd.DataFrame:
    """intent() of each text."""
    as_rows = lambda ranges: [{"start": a, "end": b} for a, b in ranges]
    return pd.DataFrame([tuple(map(as_rows, r)) if r else (None, None) for r in _each(question, intent)], columns=_INTENT.names)


@F.pandas_udf(ArrayType(IntegerType()))
def years_stated(text: pd.Series) -> pd.Series:
    """stated_years() of each text, null without any."""
    return pd.Series([None if r is None else list(r) for r in _each(text, stated_years)], dtype=object)
