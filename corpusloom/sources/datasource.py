"""Files of JSON lines as a Spark data source: spark.read.format("corpus_lines"), df.write.format("corpus_lines").

Reading: a path is a file or a folder of .jsonl files on any file system that Arrow
opens by URI. Files are cut into byte ranges, each a partition; a line belongs to the
range it begins in. Filters on columns are applied to lines before rows are made
(spark.sql.python.filterPushdown.enabled). A line that is no JSON object
makes the read fail, or, where the schema has the column _bad, is put there.

Writing takes two steps. Tasks write files into a folder of this one write; when all
are done the driver moves them to where readers look. A write that fails leaves
nothing, and a task that runs twice counts once. Mode append adds files, overwrite takes the
place of those that were there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "corpus_lines"
DEFAULT = "doc_id long, text string, lang string, source string"
BAD = "_bad"
ROWS = 2000
_STAGED = "_staged-"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the .jsonl files at a path; those of unfinished writes stand in folders of their own."""
    fs, root = _opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".jsonl"))


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


#: What a pushed filter asks of a value; a null fits none but IsNull.
_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda v, f: v is not None and v == f.value, In: lambda v, f: v is not None and v in f.value, GreaterThan: lambda v, f: v is not None and v > f.value, GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value, LessThanOrEqual: lambda v, f: v is not None and v <= f.value, StringStartsWith: lambda v, f: v is not None and v.startswith(f.value), StringContains: lambda v, f: v is not None and f.value in v,
    IsNotNull: lambda v, _: v is not None, IsNull: lambda v, _: v is None,
}


class LinesReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.schema, self.split = path, schema, split
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        plain = {f.name for f in self.schema if f.dataType.typeName() in ("long", "integer", "string", "boolean", "double")}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in plain:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [ByteRange(file, k, min(k + self.split, size)) for file, size in _files(self.path) for k in range(0, size, self.split)]

    def _lines(self, part: ByteRange) -> Iterator[bytes]:
        with _opened(self.path)[0].open_input_file(part.file) as f:
            at = max(0, part.begin - 1)
            f.seek(at)
            rest, first = b"", part.begin > 0
            while at < part.end or rest:
                block = f.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                if not block:  # the file's end
                    lines, rest = ([rest] if rest else []), b""
                for line in lines:
                    # What stands before the first line feed at or behind begin - 1 belongs to the range before.
                    if not first and at >= part.end:
                        return
                    if not first and line.strip():
                        yield line
                    first = False
                    at += len(line) + 1
                if not block:
                    return

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        names, bad = schema.names, BAD in schema.names
        rows: list[dict] = []
        for line in self._lines(part):
            try:
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("no object")
            except ValueError as fault:
                if not bad:
                    raise ValueError(f"{part.file}: {fault}: {line[:80]!r}") from None
                row = {BAD: line.decode("utf-8", "replace")}
            if all(_TESTS[type(f)](row.get(f.attribute[0]), f) for f in self.filters):
                rows.append({n: row.get(n) for n in names})
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex

    def _stage(self) -> str:
        return f"{_opened(self.path)[1]}/{_STAGED}{self.write_id}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        fs, name, rows = _opened(self.path)[0], f"{self._stage()}/part-{uuid.uuid4().hex}.jsonl", 0
        out = None
        for batch in batches:
            if len(batch) and out is None:
                fs.create_dir(self._stage(), recursive=True)
                out = fs.open_output_stream(name)
            for row in batch.to_pylist():
                out.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode("utf-8", "surrogatepass") + b"\n")
                rows += 1
        if out is not None:
            out.close()
        return Staged(name if out is not None else None, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = _opened(self.path)
        old = [f for f, _ in _files(self.path)] if self.overwrite else []
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.file:
                fs.move(m.file, f"{root}/{m.file.rsplit('/', 1)[1]}")
        for f in old:
            fs.delete_file(f)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Also files of tasks that ran twice."""
        fs = _opened(self.path)[0]
        if fs.get_file_info(self._stage()).type == pafs.FileType.Directory:
            fs.delete_dir(self._stage())


class LinesSource(DataSource):
    """Options: path; split_mb, the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DEFAULT

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"{NAME} needs a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self._path(), schema, max(1, int(float(self.options.get("split_mb", "64")) * 2**20)))

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LinesSource)
