"""A full cache of parts keeps what is asked for again, and the segmentation is the same with hardly any room."""

from __future__ import annotations

import pytest

pieces = pytest.importorskip("corpusloom.llm.pieces")

import public_tokenizers  # noqa: E402


def test_frequent_parts_are_segmented_once() -> None:
    codec = pieces.Codec(pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    text = " ".join(f"the of number{k} ▁漢{k}" for k in range(300))
    expected = codec.encode(text).tolist()
    small = pieces.Codec(codec.pieces)
    small.known.size, calls, viterbi = 5000, [], small.viterbi
    small.viterbi = lambda part: (calls.append(part), viterbi(part))[1]
    assert small.encode(text).tolist() == expected and small.decode(small.encode(text)) == text
    assert calls.count("▁of") == 1 and len(small.known) < 50
