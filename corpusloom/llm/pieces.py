"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The pieces and scores of a public vocabulary file are used as they are. The
automaton over all pieces reads a normalised text once; at each position its
output links give every piece that ends there, and each relaxes the best score
of its end from that of its beginning. The best-scored segmentation wins, ties
going to the longer last piece. A character that no piece covers becomes its
UTF-8 bytes as byte pieces (or the unknown piece), at a score below any piece.

No piece of the vocabulary has a word mark after another character, so the best
segmentation of a text is that of its parts, cut before each first mark of a
run; each different part is segmented once and kept in a bounded cache.

Normalisation is that of the vocabulary's files used here: a space becomes the
mark U+2581, one is put before a text that isn't empty, and nothing else changes.
Marks in the text itself are encoded as bytes, so decoding gives the text back
exactly. Null texts count as empty and give no ids; equal
texts give equal ids; other columns of the input play no part.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.words import Known, slices, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6  # kinds of pieces in the file format


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file, by id: the file is a protocol buffer whose field 1 repeats."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: UNKNOWN if m.is_unknown(i) else CONTROL if m.is_control(i) else BYTE if m.is_byte(i) else NORMAL
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Codec:
    CACHE = 40 << 20  # bytes of a generation of parts, about

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), None)
        lowest, self.inside = 0.0, False
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(piece[1:-1], 16)] = i
            elif kind in (NORMAL, USER_DEFINED):
                self.automaton.add_word(piece, (len(piece), score, i))
                lowest = min(lowest, score)
                self.inside |= bool(re.search(f"[^{MARK}]{MARK}", piece))
        self.automaton.make_automaton()
        self.least = lowest - 10.0
        self.known = Known(self.CACHE)
        self.known.make = lambda part: array("i", self.viterbi(part)).tobytes()
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def normalise(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text else ""

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalised text, in one pass of the automaton."""
        n, least = len(text), self.least
        best, last = [0.0] + [-math.inf] * n, [None] * (n + 1)  # last: the piece that ends there, none for a single character
        at = 0  # positions up to here are settled: the character before may have no piece of its own, and still be part of the best way

        for end, piece in self.automaton.iter(text):
            while at < end:
                value, at = best[at] + least, at + 1
                if value > best[at]:
                    best[at], last[at] = value, None
            size, score, _ = piece
            end += 1
            value = best[end - size] + score
            if value > best[end]:  # longer pieces come first
                best[end], last[end] = value, piece
        while at < n:
            value, at = best[at] + least, at + 1
            if value > best[at]:
                best[at], last[at] = value, None
        ids: list[int] = []
        while n:
            if last[n]:
                size, _, i = last[n]
                ids.append(i)
                n -= size
            else:
                n -= 1
                raw = text[n].encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown]
        return ids[::-1]

    def _segmented(self, normalised: str) -> bytes:
        return b"".join(map(self.known.__getitem__, [normalised] if self.inside else self.parts.findall(normalised)))

    def encode(self, text: str) -> np.ndarray:
        if MARK not in text or not self.bytes:
            return np.frombuffer(self._segmented(self.normalise(text)), np.int32)
        # A mark of the text itself goes as bytes, so that it isn't read back as a space.
        mark = np.array([self.bytes[b] for b in MARK.encode()], np.int32).tobytes()
        first, *rest = text.split(MARK)
        return np.frombuffer(mark.join([self._segmented(self.normalise(first) or MARK), *(self._segmented(s.replace(" ", MARK)) for s in rest)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become spaces, and the one before the text goes."""
        table = self._table
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text

    @functools.cached_property
    def _table(self) -> list[bytes]:
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        return [back.get(i) or (b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()) for i, (p, _, k) in enumerate(self.pieces)]


@functools.cache
def codec_for(path: str) -> Codec:
    """One a worker process, with its cache."""
    return Codec(read_pieces(path))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, exact) of every row; exact: decoding the ids gives the text back."""
    fields = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("exact", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for rows in slices(batches):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            ids = [codec.encode(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            columns = [
                rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_ids long, ids array<int>, ids_crc32 long, exact boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for whole in batches:
            for begin in range(0, len(whole), 500):
                rows = whole.slice(begin, 500)
                texts = ["" if ids is None else codec.decode(np.array(ids, np.int32)) for ids in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
