"""Binary modules of verses, dictionaries and books, and uploaded documents.

A module is a folder of a few index and data files that only make sense together, so a
task gets a whole module, as its files by name. Anything that doesn't fit the format is an
error: nothing is guessed.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.normalize import decoded
from corpusloom.functions.references import place
from corpusloom.functions.serving import ALLOWED_LICENSES
from corpusloom.sources.markup import tidy

Files = dict[str, bytes]
# Characters of the bytes 0x80 to 0x9F where they are punctuation.
_CP1252 = {0x82: "‚", 0x84: "„", 0x85: "…", 0x8B: "‹", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x9B: "›"}


def conf_of(files: Files, driver: str) -> dict[str, str]:
    """The settings of a module, in lower case; its licence must allow publishing, its driver be the one given."""
    text = next((b.decode("utf-8", "replace") for name, b in files.items() if name.endswith(".conf")), "")
    conf = {k.lower(): v.strip() for k, v in re.findall(r"^(\w+)=(.*)$", text, re.MULTILINE)}
    if conf.get("distributionlicense", "") not in ALLOWED_LICENSES:
        raise ValueError(f"licence {conf.get('distributionlicense')!r} is not allowed")
    if conf.get("moddrv", "").lower() != driver:
        raise ValueError(f"driver {conf.get('moddrv')!r} is not {driver}")
    return conf


def _file(files: Files, ending: str) -> bytes:
    found = [b for name, b in files.items() if name.endswith(ending)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files end in {ending}")
    return found[0]


def _records(data: bytes, form: str) -> list[tuple]:
    if len(data) % struct.calcsize(form):
        raise ValueError("an index is of no whole number of records")
    return list(struct.iter_unpack(form, data))


def _plain(raw: str) -> str:
    return " ".join(decoded(re.sub(r"<[^>]+>", " ", raw)).split())


def verse_module(files: Files, testament: str, books: list[tuple[int, list[int]]]) -> list[tuple[int, int, str]]:
    """(verse_id, verse_end, text) of a module with a slot for each verse of `books` (number, verses of each chapter).

    Slots come in order: two for the module and the testament, then one for each book, chapter and
    verse. Neighbouring verses with the same slot have one comment.
    """
    conf_of(files, "zcom")
    kind = next((k for k in "bc" if any(n.endswith(f"{testament}.{k}zv") for n in files)), None)
    if kind is None:
        return []
    slots = _records(_file(files, f"{testament}.{kind}zv"), "<IIH")
    blocks = _records(_file(files, f"{testament}.{kind}zs"), "<III")
    data = _file(files, f"{testament}.{kind}zz")
    if len(slots) != 2 + sum(1 + len(v) + sum(v) for _, v in books):
        raise ValueError("another versification")
    texts: dict[int, bytes] = {}
    out: list[tuple[int, int, str]] = []
    seen: set[tuple[int, int, int]] = set()
    at = 2
    for book, chapters in books:
        at += 1
        for chapter, verses in enumerate(chapters, 1):
            at += 1
            own = slots[at : at + verses]
            at += verses
            verse = 0
            while verse < verses:
                slot, first = own[verse], verse
                while verse < verses and own[verse] == slot:
                    verse += 1
                block, start, size = slot
                if not size or slot in seen:
                    continue
                seen.add(slot)
                if block not in texts:
                    offset, length, _ = blocks[block]
                    texts[block] = zlib.decompress(data[offset : offset + length])
                if text := _plain(texts[block][start : start + size].decode("utf-8", "replace")):
                    out.append((place(book, chapter, first + 1), place(book, chapter, verse), text))
    return out


def _decode(raw: bytes, utf8: bool) -> str:
    return raw.decode("utf-8") if utf8 else "".join(_CP1252.get(b, chr(b)) for b in raw)


def entry_text(raw: str) -> str:
    """A dictionary entry as text: paragraphs and list items on lines of their own, references' words kept."""
    raw = re.sub(r"</(?:p|title|div\d?)>", "\n\n", raw.replace("\r\n", "\n"), flags=re.IGNORECASE)
    raw = re.sub(r"</(?:item|li|l|def|list|ol|ul)>|<(?:lb|br)\s*/?>", "\n", raw, flags=re.IGNORECASE)
    raw = re.sub(r"</?(?:i|b|hi|term|foreign|em|sup|sub)\b[^>]*>", "", raw, flags=re.IGNORECASE)
    text = decoded(re.sub(r"<[^>]+>", " ", raw)).replace(" ", " ")
    return tidy(re.sub(r"\( ", "(", re.sub(r" +([,;:.!?)])", r"\1", re.sub(r"[ \t]+", " ", text))))


def dictionary_module(files: Files, least: int = 20) -> list[tuple[str, str]]:
    """(key, text) of a dictionary, compressed or not; entries that only point to another get its text, those too short are left out."""
    packed = any(n.endswith(".zdx") for n in files)
    conf = conf_of(files, "zld" if packed else "rawld")
    utf8 = conf.get("encoding", "").upper() == "UTF-8"
    data = _file(files, ".dat")
    raw: dict[str, bytes] = {}
    for offset, size in _records(_file(files, ".idx"), "<II" if packed else "<IH"):
        if not size:
            continue
        if offset + size > len(data):
            raise ValueError("an entry lies beyond the data")
        key, mark, rest = data[offset : offset + size].partition(b"\r\n")
        if not mark:
            raise ValueError("an entry has no key")
        raw[_decode(key, utf8)] = rest
    heads = {key: {key.strip().lower()} for key in raw}
    for key, rest in raw.items():
        if rest.startswith(b"@LINK"):
            target = _decode(rest[5:], utf8).strip()
            if target not in raw or raw[target].startswith(b"@LINK"):
                raise ValueError(f"{key!r} points to no entry")
            raw[key] = raw[target]
            heads[key].add(target.strip().lower())
    blocks: dict[int, bytes] = {}

    def of_block(rest: bytes) -> bytes:
        if len(rest) != 8:
            raise ValueError("an entry names no place in a block")
        block, nth = struct.unpack("<II", rest)
        if block not in blocks:
            offset, size = _records(_file(files, ".zdx"), "<II")[block]
            blocks[block] = zlib.decompress(_file(files, ".zdt")[offset : offset + size])
        b = blocks[block]
        if nth >= struct.unpack_from("<I", b)[0]:
            raise ValueError("a block has no such entry")
        offset, size = struct.unpack_from("<II", b, 4 + 8 * nth)
        return b[offset : offset + size].rstrip(b"\0")

    out: list[tuple[str, str]] = []
    for key, rest in raw.items():
        text = entry_text(_decode(of_block(rest) if packed else rest, utf8))
        first, _, more = text.partition("\n")
        text = more.lstrip("\n") if first.strip().lower() in heads[key] else text
        if len(text) >= least:
            out.append((key, text))
    return out


def book_module(files: Files) -> list[tuple[list[str], str]]:
    """(path, text) of every named node of a book that is a tree, in reading order; branches may have no text."""
    conf_of(files, "rawgenbook")
    index, nodes, texts = (_file(files, e) for e in (".idx", ".dat", ".bdt"))
    out: list[tuple[list[str], str]] = []

    def node(pointer: int) -> tuple[str, int, int, str]:
        at = struct.unpack_from("<I", index, pointer)[0]
        _, following, child = struct.unpack_from("<iii", nodes, at)
        end = nodes.index(b"\0", at + 12)
        size = struct.unpack_from("<H", nodes, end + 1)[0]
        text = ""
        if size >= 6:
            offset, length = struct.unpack_from("<IH", nodes, end + 3)
            text = _plain(texts[offset : offset + length].decode("utf-8", "replace"))
        return nodes[at + 12 : end].decode("utf-8"), following, child, text

    waiting = [(node(0)[2], [])]
    while waiting:
        pointer, trail = waiting.pop()
        if pointer == -1:
            continue
        name, following, child, text = node(pointer)
        path = [*trail, name] if name else trail
        if name:
            out.append((path, text))
        waiting += [(following, trail), (child, path)]
    return out


# ---- uploads

# Bytes of an upload and of what is unpacked from it, and characters that a page and a document need.
MOST_BYTES, MOST_UNPACKED = 25 << 20, 80 << 20
LEAST_PAGE, LEAST_DOCUMENT, MOST_LOW_PAGES = 100, 32, 0.4


class Refused(ValueError):
    """An upload that can't be taken; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def kind_of(content: bytes, name: str) -> str:
    """pdf, docx, md or txt by the first bytes; a name only tells Markdown from plain text."""
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        return "docx"
    if content and b"\0" not in content[:1024]:
        return "md" if re.search(r"\.(md|markdown|mdown)$", name, re.IGNORECASE) else "txt"
    raise Refused("unsupported_type", "neither a PDF, a Word document nor text")


def docx_text(content: bytes) -> str:
    """The words of a Word document, its paragraphs parted by blank lines. Unpacking stops at the limit, whatever the file says of its size."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            if "word/document.xml" not in z.namelist():
                raise Refused("unsupported_type", "a zip file, but no Word document")
            with z.open("word/document.xml") as f:
                xml = f.read(MOST_UNPACKED + 1)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError) as fault:
        raise Refused("corrupt", f"the file can't be unpacked: {fault}") from fault
    if len(xml) > MOST_UNPACKED:
        raise Refused("too_large_decompressed", "the file unpacks to more than is allowed")
    entity = lambda s: re.sub(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(lt|gt|quot|apos|amp));", lambda m: _character(m), s)
    out: list[str] = []
    # Runs of text, tabs, breaks and ends of paragraphs, in one pass; no part can reach over another tag.
    for m in re.finditer(r"<w:t(?:\s[^<>]*)?>([^<]*)</w:t>|(<w:tab\b[^<>]*>)|(<w:br\b[^<>]*>)|(</w:p>)", xml.decode("utf-8", "replace")):
        out.append("\t" if m[2] else "\n" if m[3] else "\n\n" if m[4] else entity(m[1]))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def _character(m: re.Match[str]) -> str:
    if m[3]:
        return {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}[m[3]]
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


def judged(kind: str, text: str, pages: list[int] | None = None) -> None:
    """Refuse what has too little text: scans (by page, then in all), and empty files."""
    solid = len(re.sub(r"\s+", "", text))
    if kind == "pdf" and pages:
        low = sum(n < LEAST_PAGE for n in pages)
        if low / len(pages) > MOST_LOW_PAGES or solid / len(pages) < LEAST_PAGE:
            raise Refused("needs_ocr", f"{low} of {len(pages)} pages have no readable text")
    if solid < LEAST_DOCUMENT:
        raise Refused("empty", "no readable text")


def upload(name: str, content: bytes) -> tuple[str | None, str | None, str | None]:
    """(kind, text, refusal) of a file; PDF needs a reader that isn't part of this library, and is refused."""
    kind = None
    try:
        if len(content) > MOST_BYTES:
            raise Refused("too_large", "the file is too large")
        kind = kind_of(content, name)
        if kind == "pdf":
            raise Refused("unsupported_type", "no reader of PDF is here")
        if kind == "docx":
            text = docx_text(content)
        else:
            try:
                text = content.decode("utf-8").strip()
            except UnicodeDecodeError as fault:
                raise Refused("unsupported_type", "not UTF-8") from fault
        judged(kind, text)
    except Refused as refusal:
        return kind, None, refusal.code
    return kind, text, None


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, kind, text, refusal) of the files in a folder; equal files have equal digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "sha256")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (file, digest, *upload(file, content))], ["file", "sha256", "kind", "text", "refusal"])

    return files.mapInArrow(run, "file string, sha256 string, kind string, text string, refusal string")
