"""Tokenizers are asked once for each word, whatever its characters, and their answers are those for whole texts."""

from __future__ import annotations

import random

import pytest

packing = pytest.importorskip("corpusloom.llm.packing")

import public_tokenizers  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SOME = [*"abcXYZ ßÀÿ÷×'’“—\x85\xa0 \x1c\t\n\r\x0b.,;-_<|>0123٣ éİKﬁ漢😀", "<|endoftext|>", "'s", "'LL", " the ", " Of", "ǅ", "é"]


def test_a_worker_keeps_its_encoder_and_asks_once_for_each_word(monkeypatch: pytest.MonkeyPatch) -> None:
    encoder = packing.encoder_for(PATH)
    assert packing.encoder_for(PATH) is encoder
    asked: list[str] = []
    tokenize, whole = encoder.tokenize, encoder._whole
    monkeypatch.setattr(encoder, "tokenize", lambda piece: (asked.append(piece), tokenize(piece))[1])
    monkeypatch.setattr(encoder, "_whole", lambda text: (asked.append(text), whole(text))[1])
    for text in ("Zxqvj, zxqvj", "“Qvjzx” zxqvj", "zxqvj“ “Qvjzx”", "ZXQVJ,"):
        assert encoder.encode(text) == whole(text)
    assert sorted(asked) == sorted({"zxqvj", "“Qvjzx”", "zxqvj“", *(set(asked) & {","})})


def test_words_of_any_characters_with_little_room(monkeypatch: pytest.MonkeyPatch) -> None:
    encoder, rng = packing.Encoder(PATH), random.Random(7)
    encoder.known.size = 3000  # bytes, so that generations change all the time
    monkeypatch.setattr(packing, "WINDOW", 20)
    for _ in range(3000):
        text = "".join(rng.choices(SOME, k=rng.randint(0, 40)))
        assert encoder.encode(text) == encoder._whole(text), text
    assert encoder.known.held < 3600 and len(encoder.known) < 30
