"""Quality rules by suffix-array repetition.

Words are runs of ``[^\\x20\\x09-\\x0D]``. The suffixes of each text, at word starts, are sorted by prefix doubling, only
tied ones anew. Longest common prefixes of neighbours in that order give the LCP intervals, by the next smaller prefix to
either side: an interval whose suffixes are not all preceded by one word is a maximal repeated substring. Those of at
least ``min_words`` words count. A suffix's innermost interval holds its longest repeat; where that is no maximal one, a
longer repeat that begins further left covers the same words, so the union of the spans of all maximal repeats is that
over the suffixes whose innermost interval is maximal. A text is kept unless the base rules fail, the covered share of
words is over ``max_share``, or the longest repeat is over both ``long_words`` words and ``long_share`` of the words.

The base rules look at windows of 8 words; ``min_words`` = 5 also finds short phrases and words said over and over, which
fill a text without one such window twice.

Null and empty texts have no words and fail. Repeated rows are judged alike. Texts are never cut: a text's arrays take about
20 times its bytes, and what compares prefixes is bounded by LEVEL_BYTES.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batches import annotated, bytes_of
from ._words import _SPACE, Words, mixed, span_hashes, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


#: Bytes of hashes of prefixes of 1, 2, 4, .. words that are kept; others are made anew from the next shorter ones.
LEVEL_BYTES = 1 << 26


class _Prefixes:
    """Hashes of the 2**k words from each word on."""

    def __init__(self, hashes: np.ndarray, levels: int) -> None:
        self.every = max(1, -(-levels * hashes.nbytes // LEVEL_BYTES))
        self.kept, now = {0: hashes}, hashes
        for k in range(1, levels):
            now = self._longer(now, k)
            if k % self.every == 0:
                self.kept[k] = now

    @staticmethod
    def _longer(h: np.ndarray, k: int) -> np.ndarray:
        half = 1 << (k - 1)
        out = h * np.uint64(0x8CB92BA72F3D8DD7)
        out[:-half] += h[half:]
        return mixed(out + np.uint64(k))

    def level(self, k: int) -> np.ndarray:
        at = k // self.every * self.every
        now = self.kept[at]
        for j in range(at + 1, k + 1):
            now = self._longer(now, j)
        return now


def _suffixes(words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """(words in the order of their suffixes within texts, slots of this order whose first word recurs in the text, doublings until no tie is left)."""
    n = len(words.hash)
    own = mixed(words.hash ^ mixed(words.doc.astype(np.uint64)))
    order = np.argsort(own).astype(np.int32 if n < 1 << 31 else np.int64)
    new = np.ones(n, bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    rank = np.empty(n + 1, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    shared = np.zeros(n, bool)  # slots of the order in a group of two or more
    shared[1:] |= ~new[1:]
    shared[:-1] |= ~new[1:]
    meets = slots = np.flatnonzero(shared)
    last, step, rounds = words.first[1:], 1, 0
    while len(slots):
        at = order[slots].astype(np.int64)
        after = at + step
        second = np.where(after < last[words.doc[at]], rank[np.minimum(after, n)], -1)
        key = rank[at] * np.int64(n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        step, rounds = step * 2, rounds + 1
        tied = np.zeros(len(key), bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
    return order, meets, rounds


def _common_prefixes(words: Words, a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Words that the suffixes from each two words have in common; less than 2**rounds."""
    lcp = np.zeros(len(a), np.int64)
    last_a, last_b = words.first[1:][words.doc[a]], words.first[1:][words.doc[b]]
    prefixes = _Prefixes(words.hash, rounds)
    for k in range(rounds - 1, -1, -1):
        h, size = prefixes.level(k), 1 << k
        at = np.flatnonzero((a + lcp + size <= last_a) & (b + lcp + size <= last_b))
        at = at[h[a[at] + lcp[at]] == h[b[at] + lcp[at]]]
        lcp[at] += size
    return lcp


def _smaller(values: np.ndarray) -> np.ndarray:
    """Of each place the next one before it with a smaller value, by jumping over places that have none; -1 if there is none."""
    left = np.arange(len(values)) - 1
    todo = np.flatnonzero(left >= 0)
    while len(todo):
        todo = todo[(left[todo] >= 0) & (values[left[todo]] >= values[todo])]
        left[todo] = left[left[todo]]
    return left


def intervals(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals of at least ``least`` words: (suffixes that share a prefix with a neighbour, in order; of each gap
    between two its common prefix, its interval's first and last suffix, and whether that is a maximal repeat).

    Gaps of one interval have the same prefix and ends; a gap of 0 belongs to none.
    """
    nothing = np.zeros(0, np.int64)
    if len(words.hash) < 2:
        return nothing, nothing, nothing, nothing, nothing.astype(bool)
    order, meets, rounds = _suffixes(words)
    at = order[meets].astype(np.int64)
    if len(at) < 2:
        return nothing, nothing, nothing, nothing, nothing.astype(bool)
    near = np.flatnonzero((meets[1:] == meets[:-1] + 1) & (words.doc[at[1:]] == words.doc[at[:-1]]) & (words.hash[at[1:]] == words.hash[at[:-1]]))
    lcp = np.zeros(len(at) - 1, np.int64)
    lcp[near] = _common_prefixes(words, at[near], at[near + 1], rounds)
    lcp[lcp < least] = 0
    inside = np.zeros(len(at), bool)  # suffixes beside a gap that counts; others are ends of chains and go
    inside[1:] |= lcp > 0
    inside[:-1] |= lcp > 0
    kept = np.flatnonzero(inside)
    if not len(kept):
        return nothing, nothing, nothing, nothing, nothing.astype(bool)
    at, gap = at[kept], np.where(np.diff(kept) == 1, lcp[np.minimum(kept[:-1], len(lcp) - 1)], 0)
    lo = _smaller(gap) + 1
    hi = len(gap) - 1 - _smaller(gap[::-1])[::-1]
    before = np.where(at > words.first[:-1][words.doc[at]], words.hash[at - 1], np.uint64(0))
    differs = np.diff(before) != 0
    differs |= (at[1:] == words.first[:-1][words.doc[at[1:]]]) | (at[:-1] == words.first[:-1][words.doc[at[:-1]]])
    changes = np.concatenate([[0], np.cumsum(differs)])
    return at, gap, lo, hi, (gap > 0) & (changes[hi] > changes[lo])


def repeats(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of each word the longest maximal repeat of at least ``least`` words that begins there and is its suffix's innermost
    interval, else 0; of each text the longest repeat; of each text the number of maximal repeats)."""
    n, texts = len(words.hash), len(words.first) - 1
    reach, longest, many = np.zeros(n, np.int64), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    at, gap, lo, hi, maximal = intervals(words, least)
    if not len(at):
        return reach, longest, many
    first = np.concatenate([[0], gap])  # the gap before each suffix, and behind it
    behind = np.concatenate([gap, [0]])
    inner = np.concatenate([[False], maximal]), np.concatenate([maximal, [False]])
    size = np.maximum(first, behind)
    reach[at] = np.where(np.where(first >= behind, *inner), size, 0)
    np.maximum.at(longest, words.doc[at], size)
    one = np.flatnonzero(maximal)
    one = one[np.unique(lo[one] * np.int64(len(at) + 1) + hi[one], return_index=True)[1]]
    np.add.at(many, words.doc[at[lo[one]]], 1)
    return reach, longest, many


def covered(words: Words, reach: np.ndarray) -> np.ndarray:
    """Of each text, the words under the union of the spans."""
    n = len(reach)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    under = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    return under[words.first[1:]] - under[words.first[:-1]]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)


def _dup_lines(raw: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    texts = len(at) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    doc = np.concatenate([np.arange(texts), np.searchsorted(at, breaks, side="right") - 1])
    start = np.concatenate([at[:-1], breaks + 1])
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    end = np.append(start[1:] - 1, at[-1])
    closes = np.append(doc[1:] != doc[:-1], True)
    end[closes] = at[doc[closes] + 1]
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    doc, start, end = doc[has], start[has], end[has]
    key = mixed(span_hashes(raw, start, end) ^ mixed(doc.astype(np.uint64)))
    lines = np.bincount(doc, minlength=texts)
    _, first = np.unique(key, return_index=True)
    return lines - np.bincount(doc[first], minlength=texts)


def measures(texts: pa.Array, least: int) -> dict:
    """The columns of quality_signals but the verdicts, as arrays."""
    raw, at = bytes_of(texts)
    words = words_of(raw, at)
    reach, longest, _ = repeats(words, min(least, 8))
    windows, spans = (np.where(reach >= size, reach, 0) for size in (8, least))
    return {
        "n_words": np.diff(words.first), "word_chars": _sums(~_SPACE[raw] & ((raw & 0xC0) != 0x80), at), "n_symbols": _sums(_SYMBOL[raw], at),
        "n_dup_lines": _dup_lines(raw, at, words), "n_repeat_words": covered(words, windows), "covered_words": covered(words, spans), "longest_repeat": np.where(longest >= least, longest, 0),
    }


def quality_signals(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 5, max_share: float = 0.3, long_words: int = 50, long_share: float = 0.2, prefix: str = "") -> DataFrame:
    """Columns ``keep`` of each row with its measures, ``base_failed`` and ``kept``."""

    def make() -> Callable[[pa.Array], dict]:
        def run(texts: pa.Array) -> dict:
            out = measures(texts, min_words)
            n = out["n_words"]
            failed = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
            good = (out["covered_words"] <= max_share * n) & (out["longest_repeat"] <= np.maximum(long_words, long_share * n))
            out |= {"base_failed": failed, "kept": ~failed & good}
            return {prefix + k: v for k, v in out.items()}

        return run

    fields = ", ".join(f"{prefix}{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")) + f", {prefix}base_failed boolean, {prefix}kept boolean"
    return annotated(df, text, list(keep), make, fields)
