"""Media columns: texts' bytes stored as WAV, and spectral-peak pair fingerprints of the stored samples.

A text's UTF-8 bytes (null: none), filled with bytes 0 to a positive multiple of 64, are the unsigned 8-bit samples of a
mono WAV file written and read by the wave module. Frames of 256 samples, 128 apart (silence after the end), go through a
Hann window and a real Fourier transform. The loudest bin of each of four bands is a peak where it is not below the same
band's peaks in the frames beside it. A peak is paired with each peak of the next three frames; a pair is one integer,
time << 20 | band bin << 11 | the other bin << 3 | frames between, so the array is sorted by time.
Equal texts give equal values; empty tables give empty results; extra columns are not looked at. Frames are transformed
in blocks of BLOCK, so a very long text needs memory for its bytes, its file and its fingerprints, not for its spectrum.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batches import annotated, bytes_of

FRAME, HOP, RATE = 256, 128, 8000
BANDS = ((1, 9), (9, 25), (25, 57), (57, 129))
REACH = 3
#: Frames that are transformed at once.
BLOCK = 4096
_HANN = np.hanning(FRAME).astype(np.float32)


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def store(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks_of(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, is a peak) by frame and band."""
    frames = -(-len(samples) // HOP)
    bins = np.empty((frames, len(BANDS)), np.int16)
    height = np.empty((frames, len(BANDS)), np.float32)
    for lo in range(0, frames, BLOCK):
        hi = min(lo + BLOCK, frames)
        signal = np.zeros((hi - lo + 1) * HOP, np.float32)
        part = samples[lo * HOP : (hi + 1) * HOP]
        signal[: len(part)] = (part.astype(np.float32) - 128) / 128
        view = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * _HANN, axis=1)).astype(np.float32)
        for k, (a, b) in enumerate(BANDS):
            bins[lo:hi, k] = a + power[:, a:b].argmax(1)
            height[lo:hi, k] = power[:, a:b].max(1)
    top = height > 0
    top[1:] &= height[1:] >= height[:-1]
    top[:-1] &= height[:-1] >= height[1:]
    return bins, top


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks, sorted."""
    bins, top = peaks_of(samples)
    blocks = []
    for lo in range(0, len(top), BLOCK):
        found = []
        for gap in range(1, REACH + 1):
            here, there = top[lo : lo + BLOCK], top[lo + gap : lo + gap + BLOCK]
            t, a, b = np.nonzero(here[: len(there), :, None] & there[:, None, :])
            t += lo
            found.append((t << 20) | (bins[t, a].astype(np.int64) << 11) | (bins[t + gap, b].astype(np.int64) << 3) | gap)
        blocks.append(np.sort(np.concatenate(found)))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def media_columns(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``media`` (the WAV file) and ``prints`` (time-coded fingerprints) of each row."""

    def make() -> Callable[[pa.Array], dict]:
        def run(texts: pa.Array) -> dict:
            media, prints = [], []
            raw, at = bytes_of(texts)
            for a, b in zip(at[:-1], at[1:], strict=True):
                media.append(store(payload(raw[a:b].tobytes())))
                prints.append(fingerprints(np.frombuffer(load(media[-1]), np.uint8)))
            return {"media": media, "prints": prints}

        return run

    return annotated(df, text, list(keep), make, "media binary, prints array<bigint>")


def media_digests(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What media_columns stores, as sizes and digests: the media need not leave the task."""

    def make() -> Callable[[pa.Array], dict]:
        def run(texts: pa.Array) -> dict:
            out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pairs")}
            raw, at = bytes_of(texts)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                media = store(payload(raw[a:b].tobytes()))
                back = load(media)
                prints = fingerprints(np.frombuffer(back, np.uint8))
                row = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(prints.astype("<i8").tobytes()).hexdigest(), len(prints))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return run

    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pairs bigint"
    return annotated(df, text, list(keep), make, fields)
