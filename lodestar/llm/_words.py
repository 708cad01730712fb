"""Words of many texts as numpy arrays: bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << int(n).bit_length()
        for k, p in enumerate((_P, _P_INV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


#: Bytes of spans that are hashed at once, and of the longest span that the polynomial hashes: of longer ones, some with a
#: pattern (such as 1,024 letters by Thue and Morse) would share it whatever the multiplier, so those get a keyed digest.
BLOCK, POLYNOMIAL = 1 << 18, 48
_KEY = b"lodestar words"


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand. Spans follow one another."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a <= BLOCK:
            out[lo:hi] = _short_hashes(raw[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    long = np.flatnonzero(ends - starts > POLYNOMIAL)
    for k, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[k] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=_KEY).digest(), "little")
    return out


def _short_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:], dtype=np.uint64)
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    doc: np.ndarray  # the text of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, its first word; one more entry at the end


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """Words are maximal runs without space and bytes 9 to 13, and never go over the end of a text."""
    if lower:
        raw = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    starts[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(s, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, s, e, span_hashes(raw, s, e), first)


def shingle_hashes(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``n`` words; a text with fewer words, but one at least, gives one hash of them all."""
    count = np.diff(words.first)
    full = np.maximum(count - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), full)
    begin = np.repeat(words.first[:-1], full) + _ramp(full)
    h = np.zeros(len(begin), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x8CB92BA72F3D8DD7) + words.hash[begin + k] if len(begin) else h
    h = mixed(h + np.uint64(n))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h2 = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            h2[has] = h2[has] * np.uint64(0x8CB92BA72F3D8DD7) + words.hash[words.first[short[has]] + k]
        h2 = mixed(h2 + count[short].astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, h2])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, end to end."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
