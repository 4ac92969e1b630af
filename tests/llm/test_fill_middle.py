"""Boundary sets against plain lists, and cuts against their definition over code points."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from odd import odd_documents
from pyspark.sql import SparkSession

from corpusloom.llm import fill_middle
from corpusloom.llm.fill_middle import ARRAY, BITMAP, RUN, BoundarySet, Config, restored, transformed


def plainly(text: str, doc_id: int | None) -> tuple:
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(alphabet=st.sampled_from("abé語😀<PSM>\n "), max_size=60), st.integers(0, 10**6))
def test_cut_and_restored(text: str, doc_id: int) -> None:
    cut = transformed(text.encode(), doc_id)
    assert (cut.n, cut.form, cut.prefix_chars, cut.middle_chars, cut.output.decode()) == plainly(text, doc_id)
    assert restored(cut.output, cut.form) == text.encode()


def test_containers_of_each_kind() -> None:
    rng = np.random.default_rng(1)
    dense, sparse, runs = rng.random(1 << 16) < 0.5, rng.random(1 << 16) < 0.01, np.arange(1 << 16) % 5000 > 10
    held = np.concatenate([dense, np.zeros(1 << 16, bool), sparse, runs, sparse[:100]])
    s = BoundarySet.of(held)
    assert [c.kind for c in s.containers] == [BITMAP, ARRAY, RUN, ARRAY][: len(s.containers)] or [c.kind for c in s.containers][:3] == [BITMAP, ARRAY, RUN]
    values = np.flatnonzero(held)
    assert len(s) == len(values)
    for k in [0, 1, len(values) - 1, *rng.integers(0, len(values), 3000).tolist()]:
        assert s.select(k) == values[k]


def test_whole_of_a_long_text() -> None:
    text = ("aé" * 100_000 + "plain " * 50_000 + "語" * 70_000)
    for doc_id in range(40):
        cut = transformed(text.encode(), doc_id)
        assert (cut.n, cut.form, cut.prefix_chars, cut.middle_chars, cut.output.decode()) == plainly(text, doc_id)


def test_odd_rows(spark: SparkSession) -> None:
    rows = [(1, None, "en"), (2, "", None), (None, "no id", "en"), (3, "same", "en"), (3, "same", "en"), (4, "has <M> in it", "de"), *((i, f"tëxt {i} " * i, "en") for i in range(5, 60))]
    found = fill_middle.transform(odd_documents(spark, rows)).collect()
    want = sorted(((d, *plainly(t or "", d)) for d, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    digests = fill_middle.transform(odd_documents(spark, rows), digests=True).collect()
    assert sorted((r.output_sha256, r.restored_sha256) for r in digests) == sorted((hashlib.sha256(w[-1].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, t in ((plainly(t or "", d), t) for d, t, _ in rows))
    assert not fill_middle.transform(odd_documents(spark, rows).limit(0)).collect()


def test_other_markers() -> None:
    config = Config(prefix=b"[[", suffix=b"||", middle=b"]]", plain_from=100)
    cut = transformed(b"some text", 5, config)
    assert restored(cut.output, cut.form, config) == b"some text" and cut.form != "plain"
