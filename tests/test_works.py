"""Readers of marked-up works, lexicons, binary modules and uploads; embedding in batches."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from corpusloom.operators import embedding
from corpusloom.sources import binary, markup

BODY = "Words enough to be a unit of its own, and then some more of them."


# ---- marked-up works


def thml(units: str) -> bytes:
    return f"<ThML><ThML.body>{units}</ThML.body></ThML>".encode()


def test_thml_units_by_type() -> None:
    units = "".join(f'<div1 type="Sermon" title="{t}"><scripRef passage="{p}"/><p>{BODY}<note>left out</note></p><verse><l>one</l><l>two</l></verse></div1>' for t, p in (("First &amp; last", "John 3:16"), ("Preface", ""), ("Second", "Rom. 8"), ("On Psalm XXIII", "")))
    found = markup.thml_sections(thml(units))
    assert [(n, h, a, b) for n, h, _, a, b in found] == [(1, "First & last", 43003016, 43003016), (2, "Second", 45008001, 45008999), (3, "On Psalm XXIII", 19023001, 19023999)]
    assert "left out" not in found[0][2]
    assert found[0][2].endswith("one\ntwo")


def test_thml_titles_where_no_type_is() -> None:
    units = "".join(f'<div2 title="Chapter {n}"><p>{BODY}</p></div2>' for n in (1, 2, 3))
    assert [(h, a) for _, h, _, a, _ in markup.thml_sections(thml(units), book=40)] == [("Chapter 1", 40001001), ("Chapter 2", 40002001), ("Chapter 3", 40003001)]
    assert markup.thml_sections(thml('<div2 title="a"><p>x</p></div2>')) == []


def test_tei_notes_by_verse() -> None:
    book = '<div type="book"><head>The first book of MOSES called GENESIS</head><head>CHAP. II.</head><p n="1">Text<note place="bottom">On <gap reason="x">lost</gap>this</note></p><p>Next<note place="bottom">Second<g ref="char:EOLhyphen"/>\n half</note><note place="side">no</note></p></div>'
    assert markup.tei_annotations(f"<TEI><text>{book}</text></TEI>".encode()) == [(1002001, "On ⟨…⟩ this"), (1002002, "Secondhalf")]
    assert markup.book_of_head("THE SECOND EPISTLE OF PAUL TO THE CORINTHIANS") == 47
    assert markup.book_of_head("The Gospel of JOHN") == 43
    assert markup.book_of_head("THE FIRST EPISTLE OF JOHN") == 62
    assert markup.book_of_head("A table of contents") is None


def test_ebook_sections() -> None:
    text = f"header\n*** START OF THIS BOOK ***\n\n\nCONTENTS\none\ntwo\n\n\nBEGIN\n\nONE\n\nJohn iii. 16\n{BODY}\n[a note\nover lines]\n\nTWO\n\n{BODY}\n*** END OF THIS BOOK ***\nlicence"
    found = markup.ebook_sections(text.encode(), start="^BEGIN$", headings=["^ONE$", "^TWO$"], apparatus=True)
    assert [(n, h, a, b) for n, h, _, a, b in found] == [(1, "ONE", 43003016, 43003016), (2, "TWO", None, None)]
    assert "note" not in found[0][2]
    with pytest.raises(ValueError, match="no line fits"):
        markup.ebook_sections(text.encode(), start="^NOWHERE$")


def test_roman_numerals() -> None:
    assert [markup.roman(x) for x in ("i", "IV", "xix", "MCMXC", "", "x1")] == [1, 4, 19, 1990, None, None]


def test_lexicons() -> None:
    index = '<xref bdb="a.1" strong="1"/><xref bdb="a.1" strong="2"/>'
    lexicon = '<lex><entry id="a.1"><w>אב</w> father<status>done</status></entry><entry id="a.2"><w>אב</w> green</entry></lex>'
    assert markup.hebrew_lexicon(lexicon.encode(), index) == [("H1+H2 אב", "אב father"), ("bdb:a.2 אב", "אב green")]
    greek = "### λόγος — word\n\n`Strong's G3056`\n\nA word.\n\n---\n### -\n- Original: ἐν\n\nIn."
    assert markup.greek_lexicon(greek.encode(), "f") == [("G3056 λόγος", "A word."), ("thayer:f:2 ἐν", "- Original: ἐν\n\nIn.")]
    script = 'var d = {"G1":{lemma:"Α",translit:"A",strongs_def:" first, x:1 ",},}; module.exports = d;'
    assert markup.number_dictionary(script.encode()) == [("G1", "Α", "A", "", "first, x:1", "", "")]
    with pytest.raises(ValueError, match="no id"):
        markup.hebrew_lexicon(b"<lex><entry><w>x</w> y</entry></lex>", "")


def test_tagged_originals() -> None:
    lexicon = {"H7225": ("רֵאשִׁית", "rēʼšîṯ", "the first, in place", "")}
    book = '<verse osisID="Gen.1.1"><w lemma="b/7225" morph="HR/Ncfsa">בְּ/רֵאשִׁית</w><w lemma="9003"> </w><w lemma="9003">x</w></verse>'
    assert markup.hebrew_words(book.encode(), lexicon) == [(1, 1, 0, "בְּרֵאשִׁית", "רֵאשִׁית", "rēʼšîṯ", "H7225", "HR/Ncfsa", "the first"), (1, 1, 1, "x", "", "", "", "", "")]
    assert markup.greek_words("040101 N- ----NSF- Βίβλος Βίβλος βίβλος βίβλος\nshort".encode(), {"G976": ("βίβλος", "biblos", "(a) book; roll", "")}) == [(1, 1, 0, "Βίβλος", "βίβλος", "biblos", "G976", "N- ----NSF-", "book")]


def test_files_of_another_form_are_set_apart(spark: SparkSession, tmp_path: Path) -> None:
    for n in range(3):
        (tmp_path / f"{n}.xml").write_bytes(f"<lex><entry id='a'><w>w</w> text {n}</entry></lex>".encode())
    (tmp_path / "bad.xml").write_text("<lex><entry><w>w</w></entry></lex>")
    rows, faults = markup.read_files(spark, str(tmp_path), lambda b: markup.hebrew_lexicon(b, ""), "key string, text string")
    assert sorted(r.text for r in rows.collect()) == ["w text 0", "w text 1", "w text 2"]
    assert ["ValueError" in r.reason for r in faults.collect()] == [True]


# ---- binary modules

CONF = "[X]\nDistributionLicense=Public Domain\nModDrv={}\nEncoding=UTF-8\n"


def test_verse_module() -> None:
    block = "first<b>one</b>third".encode()
    packed = zlib.compress(block)
    slots = [(0, 0, 0)] * 4 + [(0, 0, 5), (0, 0, 5), (0, 5, 10)]
    files = {"x.conf": CONF.format("zCom").encode(), "nt.bzv": b"".join(struct.pack("<IIH", *s) for s in slots), "nt.bzs": struct.pack("<III", 0, len(packed), len(block)), "nt.bzz": packed}
    assert binary.verse_module(files, "nt", [(40, [3])]) == [(40001001, 40001002, "first"), (40001003, 40001003, "one")]
    with pytest.raises(ValueError, match="versification"):
        binary.verse_module(files, "nt", [(40, [4])])
    with pytest.raises(ValueError, match="licence"):
        binary.verse_module(files | {"x.conf": b"DistributionLicense=Copyrighted\nModDrv=zCom"}, "nt", [(40, [3])])


def test_dictionary_module() -> None:
    entries = [("AARON", b"AARON\n<def>the brother of Moses &amp; others</def>"), ("ABEL", b"@LINK AARON"), ("X", b"short")]
    data, index = b"", b""
    for key, raw in entries:
        one = key.encode() + b"\r\n" + raw
        index += struct.pack("<IH", len(data), len(one))
        data += one
    files = {"x.conf": CONF.format("RawLD").encode(), "x.idx": index, "x.dat": data}
    assert binary.dictionary_module(files) == [("AARON", "the brother of Moses & others"), ("ABEL", "the brother of Moses & others")]
    block = struct.pack("<I", 1) + struct.pack("<II", 12, 31) + b"the first man, who named beasts"
    packed = zlib.compress(block)
    one = b"ADAM\r\n" + struct.pack("<II", 0, 0)
    files = {"x.conf": CONF.format("zLD").encode(), "x.idx": struct.pack("<II", 0, len(one)), "x.dat": one, "x.zdx": struct.pack("<II", 0, len(packed)), "x.zdt": packed}
    assert binary.dictionary_module(files) == [("ADAM", "the first man, who named beasts")]


def test_book_module() -> None:
    texts = b"<p>Intro</p>deep"

    def node(name: str, following: int, child: int, text: tuple[int, int] | None) -> bytes:
        return struct.pack("<iii", -1, following, child) + name.encode() + b"\0" + (struct.pack("<HIH", 6, *text) if text else struct.pack("<H", 0))

    nodes, index = b"", b""
    for n in (node("", -1, 4, None), node("Part", 12, 8, (0, 12)), node("Section", -1, -1, (12, 4)), node("End", -1, -1, None)):
        index += struct.pack("<I", len(nodes))
        nodes += n
    files = {"x.conf": CONF.format("RawGenBook").encode(), "x.idx": index, "x.dat": nodes, "x.bdt": texts}
    assert binary.book_module(files) == [(["Part"], "Intro"), (["Part", "Section"], "deep"), (["End"], "")]


# ---- uploads


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_uploads(spark: SparkSession, tmp_path: Path) -> None:
    words = "Enough words for a document, truly."
    (tmp_path / "a.docx").write_bytes(docx(f"<w:p><w:r><w:t>{words}</w:t><w:tab/><w:t xml:space='preserve'>a &lt; b &#38; c &#xD800;</w:t></w:r></w:p><w:p><w:t>next</w:t></w:p>"))
    (tmp_path / "b.md").write_text(f"# Title\n{words}")
    (tmp_path / "c.txt").write_text("too short")
    (tmp_path / "d.bin").write_bytes(b"\x00\x01")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "f.zip").write_bytes(b"PK\x03\x04 but no zip file")
    (tmp_path / "g.txt").write_bytes(words.encode() + b"\xff")
    found = {Path(r.file).name: (r.kind, r.text, r.refusal) for r in binary.uploads(spark, str(tmp_path)).collect()}
    assert found == {
        "a.docx": ("docx", f"{words}\ta < b & c &#xD800;\n\nnext", None), "b.md": ("md", f"# Title\n{words}", None), "c.txt": ("txt", None, "empty"), "d.bin": (None, None, "unsupported_type"),
        "e.pdf": ("pdf", None, "unsupported_type"), "f.zip": ("docx", None, "corrupt"), "g.txt": ("txt", None, "unsupported_type"),
    }


def test_unpacking_stops(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(binary, "MOST_UNPACKED", 1000)
    with pytest.raises(binary.Refused) as refusal:
        binary.docx_text(docx("<w:t>" + "x" * 5000 + "</w:t>"))
    assert refusal.value.code == "too_large_decompressed"


def test_pages_without_text_are_scans() -> None:
    binary.judged("pdf", "x" * 5000, [400] * 10)
    for pages in ([0] * 5 + [1000] * 5, [50] * 10):
        with pytest.raises(binary.Refused) as refusal:
            binary.judged("pdf", "x" * sum(pages), pages)
        assert refusal.value.code == "needs_ocr"


# ---- embedding


def lengths() -> embedding.Embedder:
    class Lengths:
        """Embeds a text as its length; fails for a word and refuses long ones."""

        model = "lengths"

        def embed(self, texts: list[str]) -> list[list[float]]:
            if any("poison" in t for t in texts):
                raise RuntimeError("no answer")
            if any(len(t) > 40 for t in texts):
                raise OverflowError("too long")
            return [[float(len(t)), 1.0] for t in texts]

    return Lengths()


def test_ingest(spark: SparkSession, tmp_path: Path) -> None:
    rows = [(i, f"text {i}") for i in range(10)] + [(10, "poison"), (11, "y" * 100), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    store = embedding.ParquetStore(str(tmp_path / "store"), ["doc_id"])
    options = {"batch": 4, "wait": 0.0, "too_long": lambda fault: "long" in str(fault), "retry": lambda fault: "long" not in str(fault)}
    assert embedding.ingest(docs, lengths(), store, str(tmp_path / "one"), **options) == {"embedded": 9, "upserted": 9, "failed": 4}
    stored = spark.read.parquet(str(tmp_path / "store"))
    again = embedding.missing(docs, stored, ["doc_id"])
    assert sorted(r.doc_id for r in again.collect()) == [8, 9, 10, 11]
    assert embedding.ingest(again.where("doc_id <> 10"), lengths(), store, str(tmp_path / "two"), **options) == {"embedded": 3, "upserted": 3, "failed": 0}
    long = spark.read.parquet(str(tmp_path / "store")).where("doc_id = 11").first().embedding
    assert sum(x * x for x in long) == pytest.approx(1)
    assert embedding.one_model(spark.read.parquet(str(tmp_path / "store")), "lengths").count() == 12
    with pytest.raises(ValueError, match="other models"):
        embedding.one_model(spark.read.parquet(str(tmp_path / "store")), "widths")


def test_rows_go_as_json(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "x").write_text(json.dumps({}))
    rows, faults = markup.read_files(spark, str(tmp_path), lambda b: [(1, 'quoted "text"\n', None)], "n long, t string, p long")
    assert [tuple(r)[1:] for r in rows.collect()] == [(1, 'quoted "text"\n', None)]
    assert faults.collect() == []
