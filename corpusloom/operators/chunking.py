"""Texts cut into pieces of bounded length, whole paragraphs and sentences where they fit.

Each cutter is a rule for one text; `chunked` applies it in Arrow batches, so rows
stay where they are and nothing is shuffled. Null and empty texts give no
pieces. Nothing but white space at the cuts is lost. Lengths are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Piece = tuple[str | None, str]  # heading in force, text
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH = re.compile(r"\n{2,}")
_ROWS = 128
NUMBERED = re.compile(r"([IVXLC]+|[0-9]{1,2})[.)]?\s+\S")


def filled(parts: Iterable[str], most: int, glue: str, cut: Callable[[str], int] | None = None, trim: bool = False) -> Iterator[str]:
    """Neighbouring parts joined while they fit; what is longer alone is cut at `cut`, or at the bound."""
    held = ""
    for part in parts:
        joined = held + glue + part if held else part
        if held and len(joined) > most:
            yield held
            joined = part
        begin = 0
        while len(joined) - begin > most:
            room = joined[begin : begin + most + 1]
            stop = begin + (cut(room) if cut else most)
            yield joined[begin:stop].rstrip() if trim else joined[begin:stop]
            begin = stop
            while trim and begin < len(joined) and joined[begin].isspace():
                begin += 1
        held = joined[begin:]
    if held:
        yield held


def is_heading(line: str) -> bool:
    """A short line without end mark that is all capitals or begins with a number."""
    line = line.strip()
    letters = re.sub("[^A-Za-z]", "", line)
    short = 0 < len(line) <= 80 and len(line.split()) <= 10 and len(letters) >= 3
    return short and line[-1] not in ".!?,;:" and (letters.isupper() or NUMBERED.match(line) is not None)


def prose(text: str, most: int = 1200) -> Iterator[Piece]:
    """Paragraphs packed together under the heading before them; headings are no part of the text."""
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    for block in map(str.strip, PARAGRAPH.split(re.sub(r"\r\n?", "\n", text))):
        if "\n" not in block and is_heading(block):
            sections.append((block, []))
        elif block:
            sections[-1][1].append(block)
    for heading, blocks in sections:
        sentences = (p for b in blocks for p in ([b] if len(b) <= most else filled(filter(str.strip, SENTENCE.split(b)), most, " ")))
        yield from ((heading, piece.strip()) for piece in filled(sentences, most, "\n\n") if piece.strip())


def paragraphs(text: str, most: int = 800) -> Iterator[Piece]:
    """Paragraphs packed together; a longer one is cut at the bound and its pieces stand alone."""
    run: list[str] = []
    for block in [b for b in map(str.strip, PARAGRAPH.split(text)) if b]:
        if len(block) <= most:
            run.append(block)
            continue
        yield from ((None, piece) for piece in filled(run, most, "\n\n"))
        yield from ((None, block[at : at + most]) for at in range(0, len(block), most))
        run = []
    yield from ((None, piece) for piece in filled(run, most, "\n\n"))


def last_blank(room: str) -> int:
    """Where the last blank, else the last line end, of the later half of the room is; its end if there is none."""
    most = len(room) - 1
    return next((at for at in (room.rfind(" "), room.rfind("\n")) if at > most / 2), most)


def sentences(text: str, most: int = 1200) -> Iterator[Piece]:
    """Sentences packed together; a longer one is cut at a blank."""
    parts = [text] if len(text) <= most else re.split(r"(?<=[.!?])\s+|\n\n+", text)
    return ((None, piece) for piece in filled(parts, most, " ", last_blank, trim=True) if piece)


def narrative(text: str, most: int = 1800, over: int = 1200, again: int = 1000) -> Iterator[Piece]:
    """Sentences packed together; pieces over `over` are packed again to `again`. Headings are "(i/n)" where there are several."""

    def once(t: str, limit: int) -> list[str]:
        return [t] if len(t) <= limit else list(filled(SENTENCE.split(t), limit, " "))

    pieces = [p for first in once(text, most) for p in (once(first, again) if len(first) > over else [first])]
    return ((f"({i}/{len(pieces)})" if len(pieces) > 1 else None, p) for i, p in enumerate(pieces, 1) if p)


def chunked(docs: DataFrame, key: str, cutter: Callable[[str], Iterable[Piece]], text: str = "text") -> DataFrame:
    """(key, ordinal, heading, text): the pieces of each row's text, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may have megabytes of text, so only a few rows at a time are cut.
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [(n, i, h, piece) for n, t in enumerate(part.column(1).to_pylist()) if t for i, (h, piece) in enumerate(cutter(t))]
                of, ordinal, heading, pieces = ([r[c] for r in rows] for c in range(4))
                own = part.column(0).take(pa.array(of, pa.int32()))
                yield pa.RecordBatch.from_arrays([own, pa.array(ordinal, pa.int32()), pa.array(heading, pa.string()), pa.array(pieces, pa.string())], [key, "ordinal", "heading", "text"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ordinal int, heading string, text string")
