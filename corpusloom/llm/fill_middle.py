"""Fill-in-middle: each text is cut in two places and put together again, middle last.

A text's code points begin at certain bytes of its UTF-8. These bytes, and the one
after the last, are its boundary set, held as in a roaring bitmap: every 65536
bytes make a container of the cheapest kind (a sorted array, a bitmap, or runs),
and the containers have cumulative cardinalities. The k-th boundary is found by
a search for its container and a select within it; so both cuts, drawn as
numbers of code points, become byte offsets, and no text is decoded.

The draws are hex groups of the SHA-256 of seed and doc_id, so a row's result
depends on nothing else and is the same after a lost task. Rows that repeat a
doc_id are cut by the same draws; a null doc_id draws as the empty string.
Null texts count as empty; empty texts, and those that hold a marker, stay plain.
Other columns of the input play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.words import chunks, tidy

SPAN = 1 << 16  # values of a container
ARRAY, BITMAP, RUN = "array", "bitmap", "run"
_ONES = np.array([b.bit_count() for b in range(256)], np.int64)
_PLACES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)  # (byte, bit)


@dataclass(frozen=True)
class Container:
    """Some values of one span, as 16-bit places in it.

    data is, by kind, the sorted places; the bits as bytes, lowest first; or the
    first places of runs. rank counts the values before each of data's elements,
    and before its end; an array needs none.
    """

    kind: str
    data: np.ndarray
    rank: np.ndarray | None

    @classmethod
    def of(cls, held: np.ndarray) -> Container:
        """Of booleans for the places of a span; the kind that takes the fewest bytes."""
        edge = np.diff(held.astype(np.int8), prepend=0, append=0)
        first = np.flatnonzero(edge == 1)
        count = int(np.count_nonzero(held))
        cost = {RUN: 2 + 4 * len(first), ARRAY: 2 * count, BITMAP: SPAN // 8}
        kind = min(cost, key=cost.__getitem__)
        if kind == RUN:
            sizes = np.flatnonzero(edge == -1) - first
            return cls(kind, first.astype(np.uint16), np.concatenate([[0], np.cumsum(sizes)]))
        if kind == ARRAY:
            return cls(kind, np.flatnonzero(held).astype(np.uint16), None)
        bits = np.packbits(held, bitorder="little")
        return cls(kind, bits, np.concatenate([[0], np.cumsum(_ONES[bits])]))

    def __len__(self) -> int:
        return len(self.data) if self.rank is None else int(self.rank[-1])

    def select(self, k: int) -> int:
        """The k-th place, from 0."""
        if self.rank is None:
            return int(self.data[k])
        at = int(np.searchsorted(self.rank, k, "right")) - 1
        within = k - int(self.rank[at])
        if self.kind == RUN:
            return int(self.data[at]) + within
        return 8 * at + int(np.flatnonzero(_PLACES[self.data[at]])[within])


class BoundarySet:
    """Increasing non-negative integers in containers by their upper bits."""

    def __init__(self, upper: list[int], containers: list[Container]):
        self.upper, self.containers = upper, containers
        self.cumulative = np.concatenate([[0], np.cumsum([len(c) for c in containers], dtype=np.int64)])

    @classmethod
    def of(cls, held: np.ndarray) -> BoundarySet:
        """Of booleans for 0 and on."""
        upper, containers = [], []
        for k in range(0, len(held), SPAN):
            part = held[k : k + SPAN]
            if part.any():
                upper.append(k // SPAN)
                containers.append(Container.of(part))
        return cls(upper, containers)

    @classmethod
    def of_code_points(cls, text: bytes) -> BoundarySet:
        """The bytes at which code points begin, and the end of the text."""
        held = np.ones(len(text) + 1, bool)
        held[:-1] = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        return cls.of(held)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.cumulative, k, "right")) - 1
        return self.upper[c] * SPAN + self.containers[c].select(k - int(self.cumulative[c]))


@dataclass(frozen=True)
class Config:
    seed: str = "1"
    plain_from: int = 90  # of 100: the third draw from here on leaves a text plain
    spm_below: int = 20  # of 100: the fourth draw below this puts the suffix first
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    @property
    def markers(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Cut:
    """What became of a text: its form ("plain", "psm" or "spm"), code points, those of prefix and middle (None if plain), and the output."""

    form: str
    n: int
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: bytes, doc_id: int | None, config: Config = Config()) -> Cut:
    bounds = BoundarySet.of_code_points(text)
    n = len(bounds) - 1
    h1, h2, h3, h4 = draws(doc_id, config.seed)
    if not text or h3 % 100 >= config.plain_from or any(m in text for m in config.markers):
        return Cut("plain", n, None, None, text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < config.spm_below:
        form, parts = "spm", (config.suffix, suffix, config.prefix, prefix)
    else:
        form, parts = "psm", (config.prefix, prefix, config.suffix, suffix)
    return Cut(form, n, first, second - first, b"".join([*parts, config.middle, middle]))


def restored(output: bytes, form: str, config: Config = Config()) -> bytes:
    """The text that a Cut was made from. No marker is in a text that isn't plain, and none can arise where parts meet, as none overlaps another."""
    if form == "plain":
        return output
    one, two = (config.suffix, config.prefix) if form == "spm" else (config.prefix, config.suffix)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with its marker")
    x, _, rest = output[len(one) :].partition(two)
    y, _, middle = rest.partition(config.middle)
    prefix, suffix = (y, x) if form == "spm" else (x, y)
    return prefix + middle + suffix


def transform(documents: DataFrame, config: Config = Config(), digests: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; with digests the SHA-256 of the output and of the text rebuilt from it, in its place."""
    last = [("output_sha256", pa.string()), ("restored_sha256", pa.string())] if digests else [("output", pa.string())]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            ids = rows.column("doc_id").cast(pa.int64())
            found = []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                cut = transformed(text, doc_id, config)
                end = [hashlib.sha256(x).hexdigest() for x in (cut.output, restored(cut.output, cut.form, config))] if digests else [cut.output]
                found.append((doc_id, cut.n, cut.form, cut.prefix_chars, cut.middle_chars, *end))
            columns = [pa.array(x, pa.binary() if f.name == "output" else f.type).cast(f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, n long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digests else "output string")
    return documents.select("doc_id", "text").mapInArrow(tidy(run), out)


#: The same with the default configuration, in DuckDB's SQL; documents is a view.
SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), numbers as (
  select doc_id, t, n, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2, ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4 from drawn
), formed as (
  select *, least(c1, c2) as p, greatest(c1, c2) as m,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form
  from numbers
), parts as (select *, substring(t, 1, p) as prefix, substring(t, p + 1, m - p) as middle, substring(t, m + 1) as suffix from formed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m - p end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
