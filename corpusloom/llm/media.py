"""Media columns: texts as 8-bit WAV, and spectral-peak fingerprints of the samples.

A payload is the text's UTF-8, padded with bytes 32 to a positive multiple of
192; its bytes are the unsigned 8-bit mono samples of a WAV file that the wave
module writes and reads. Features come from the samples read back: short-time
Fourier transforms (Hann window, frames half a frame apart, and half a frame of
zero level before and behind, so that every sample weighs as much as any other), peaks, which
are the strongest of each frame's local maxima in time and frequency, and
pairs of a peak with those of the next frames. Each frame's mean is taken off first. A fingerprint is an array of
(time, code), code being the two bins and the frames between them.

Null texts count as empty, so they give a payload of 192 spaces; equal texts
give equal values; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.words import chunks, tidy


@dataclass(frozen=True)
class Config:
    unit: int = 192
    rate: int = 8000
    frame: int = 512
    hop: int = 256
    peaks: int = 2  # of each frame, at most
    near: tuple[int, int] = (1, 3)  # frames and bins on each side that a peak stands out from
    reach: int = 2  # a peak is paired with those of so many next frames


def payload(text: bytes, unit: int = 192) -> bytes:
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def to_wav(samples: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(samples: bytes, config: Config) -> np.ndarray:
    """(frame, bin) magnitudes of frames that begin half a frame before the first sample and are hop apart; each sample is in the middle of one or between two."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    half = config.frame // 2
    count = 1 + -(-len(x) // config.hop)
    padded = np.zeros((count - 1) * config.hop + config.frame, np.float32)
    padded[half : half + len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, config.frame)[:: config.hop][:count]
    frames = frames - frames.mean(axis=1, keepdims=True)  # else the mean leaks into the lowest bins
    return np.abs(np.fft.rfft(frames * np.hanning(config.frame).astype(np.float32), axis=1))


def _highest(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The greatest value among `reach` neighbours on each side along an axis."""
    out = x.copy()
    for d in range(1, min(reach, x.shape[axis] - 1) + 1):
        low, high = [slice(None)] * 2, [slice(None)] * 2
        low[axis], high[axis] = slice(None, -d), slice(d, None)
        np.maximum(out[tuple(low)], x[tuple(high)], out=out[tuple(low)])
        np.maximum(out[tuple(high)], x[tuple(low)], out=out[tuple(high)])
    return out


def peaks(magnitude: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks without bin 0, in order of frame and bin. Equal neighbours are all local maxima; of equally strong ones in a frame lower bins are taken."""
    m = magnitude[:, 1:].round(3)
    top = (m == _highest(_highest(m, config.near[1], 1), config.near[0], 0)) & (m > 0)
    frame, at = np.nonzero(top)
    order = np.lexsort((at, -m[frame, at], frame))
    frame, at = frame[order], at[order]
    first = np.searchsorted(frame, frame)
    kept = np.arange(len(frame)) - first < config.peaks
    frame, at = frame[kept], at[kept] + 1
    order = np.lexsort((at, frame))
    return frame[order], at[order]


def fingerprint(frame: np.ndarray, bins: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of every pair of a peak and one of the next frames, by time and then code."""
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ahead in range(1, config.peaks * (config.reach + 1)):  # peaks further on in the list are in later frames than config.reach
        step = frame[ahead:] - frame[:-ahead]
        pair = np.flatnonzero((step > 0) & (step <= config.reach))
        times.append(frame[pair])
        codes.append((bins[pair].astype(np.int64) << 20) | (bins[pair + ahead].astype(np.int64) << 8) | step[pair])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order]


def media(documents: DataFrame, config: Config = Config(), keep_wav: bool = False) -> DataFrame:
    """Every row with its stored form's figures and its fingerprint as (times, codes); with keep_wav also the WAV bytes."""

    def row(raw: bytes) -> tuple:
        stored = to_wav(payload(raw, config.unit), config.rate)
        samples = from_wav(stored)
        magnitude = spectrum(samples, config)
        t, c = fingerprint(*peaks(magnitude, config), config)
        feature = f"frames={len(magnitude)};pairs={len(t)};sha256={hashlib.sha256(t.astype('<i4').tobytes() + c.astype('<i8').tobytes()).hexdigest()}"
        out = (len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, t, c)
        return (*out, stored) if keep_wav else out

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    fields = [("doc_id", pa.int64()), *((c, pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c in names), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64()))] + [("wav", pa.binary())] * keep_wav

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            columns = zip(*(row(t) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *(pa.array(x, kind) for x, (_, kind) in zip(columns, fields[1:], strict=True))], schema=pa.schema(fields))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<long>"
    return documents.select("doc_id", "text").mapInArrow(tidy(run), schema + ", wav binary" * keep_wav)
