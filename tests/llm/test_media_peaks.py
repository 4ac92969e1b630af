"""Fingerprints against a plain transform and a plain search for local maxima."""

from __future__ import annotations

import cmath
import math

import numpy as np
from odd import odd_documents
from pyspark.sql import SparkSession

from corpusloom.llm import media
from corpusloom.llm.media import Config


def plain_spectrum(samples: bytes, config: Config) -> list[list[float]]:
    half, n = config.frame // 2, len(samples)
    value = lambda i: samples[i] - 128.0 if 0 <= i < n else 0.0
    out = []
    for f in range(1 + -(-n // config.hop)):
        x = [value(f * config.hop - half + i) for i in range(config.frame)]
        mean = sum(x) / len(x)
        x = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (config.frame - 1))) for i, v in enumerate(x)]
        out.append([abs(sum(v * cmath.exp(-2j * math.pi * k * i / config.frame) for i, v in enumerate(x))) for k in range(config.frame // 2 + 1)])
    return out


def plain_peaks(m: np.ndarray, config: Config) -> list[tuple[int, int]]:
    m = m.round(3)
    found = []
    for f in range(m.shape[0]):
        own = []
        for k in range(1, m.shape[1]):
            around = m[max(0, f - config.near[0]) : f + config.near[0] + 1, max(1, k - config.near[1]) : k + config.near[1] + 1]
            if m[f, k] > 0 and m[f, k] == around.max():
                own.append((-m[f, k], k))
        found += sorted((f, k) for _, k in sorted(own)[: config.peaks])
    return found


def test_against_plain_transform() -> None:
    config = Config(frame=32, hop=16)
    samples = media.payload("Ein Text, 12 words of some kind.".encode() * 4, 192)
    got = media.spectrum(samples, config)
    assert np.allclose(got, plain_spectrum(samples, config), rtol=1e-3, atol=0.05)
    frame, bins = media.peaks(got, config)
    assert list(zip(frame.tolist(), bins.tolist(), strict=True)) == plain_peaks(got, config)
    t, c = media.fingerprint(frame, bins, config)
    plain = sorted((int(f), (int(k) << 20) | (int(k2) << 8) | int(g - f)) for f, k in zip(frame, bins, strict=True) for g, k2 in zip(frame, bins, strict=True) if 0 < g - f <= config.reach)
    assert list(zip(t.tolist(), c.tolist(), strict=True)) == plain


def test_every_byte_weighs() -> None:
    """A changed byte shows wherever it stands: at the borders of frames, and first and last of all."""
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 123, 192 * 8).astype(np.uint8))
    of = lambda b: [x.tolist() for x in media.fingerprint(*media.peaks(media.spectrum(b, Config()), Config()), Config())]
    same = of(raw)
    for at in (0, 255, 256, 511, 512, 767, 768, 1024, len(raw) - 1):
        changed = bytearray(raw)
        changed[at] ^= 0x80
        assert of(bytes(changed)) != same, at


def test_odd_rows(spark: SparkSession) -> None:
    rows = [(1, None, "en"), (2, "", None), (3, "same", "en"), (4, "same", "de"), (None, "no id", "en"), (5, "lang " * 100_000, "en")]
    docs = odd_documents(spark, rows)
    got = {r.doc_id: r for r in media.media(docs, keep_wav=True).collect()}
    assert len(got) == 6 and got[1].feature == got[2].feature and got[3].feature == got[4].feature and got[3].times == got[4].times
    assert media.from_wav(bytes(got[5].wav)) == media.payload(("lang " * 100_000).encode())
    assert not media.media(docs.limit(0)).collect()
