"""BPE encoding by tree concatenation, and decoding.

A text of more than ``leaf`` characters that is encoded without being split first is halved, down to leaves; the leaves
of a whole batch are encoded together. Neighbours are joined up the tree: a window around the join is encoded anew and
grows until both sides agree with it exactly. A side agrees where the window ends at a place at which the tokenizer's
own splitting surely starts afresh (white space behind anything else), or inside a run of letters, digits, signs or
white space that the splitting can't part there, if the window's outermost tokens are those that the side has: a run's
tokens are its encoding if each two neighbours are that of theirs, which the shared tokens carry over. A window that
reaches both ends is the plain encoding of the two.

A leaf's units (runs of letters, digits or signs, each with the space before it; words with any other character whole)
repeat, so their ids are kept in a bounded table of each worker, found by a 64-bit hash of units up to 48 bytes.
Null texts count as empty and have no tokens. Strings of special tokens become special tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._batches import annotated
from ._words import _ramp, span_hashes

#: White space beyond ASCII, and characters that were white space in some version of Unicode; texts with them are not cut into units.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: What parts units that are encoded as one text: it is one token there, and no other unit is.
_MARK = {"space_first": "\n", "no_space": "7"}
#: Units and ids in a worker's table, and the bytes of its longest unit; bytes of text whose units are found at once.
TABLE, TABLE_IDS, LONGEST, AT_ONCE = 250_000, 2_000_000, 48, 1 << 20

#: Kinds of bytes: white space, letters, signs, digits, and what only the library knows about (an apostrophe may begin an ending).
_SPACE, _LETTER, _SIGN, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(9, 14)]] = _SPACE
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _SIGN
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KIND[[b for b in range(128) if chr(b).isdigit()]] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte; the letters of Latin-1 beyond ASCII begin with byte C3."""
    kind = _KIND[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3)
    at = at[(raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    return kind


def _folded(raw: np.ndarray) -> np.ndarray:
    """Letters of Latin-1 in lower case."""
    out = _LOWER[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    at = at[(raw[at] < 0x9F) & (raw[at] != 0x97)]
    out[at] += 0x20
    return out


def units(raw: np.ndarray, at: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether a byte is in a word that only the library knows to split) of the units of texts end to end.

    White space is dropped, or with ``spaces`` goes as GPT-2's splitting has it: one space with the unit after it, the
    rest of a run, and a last one that is no space, apart."""
    kind = _kinds(raw)
    space = kind == _SPACE
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    edge[0] = edge[-1] = True
    turn = np.ones(len(raw) + 1, bool)
    turn[1:-1] = space[1:] != space[:-1]
    turn |= edge
    run = np.flatnonzero(turn)  # words and runs of white space, and the end
    first, last = run[:-1], run[1:]
    blank = space[first]
    word_first, word_last = first[~blank], last[~blank]
    which = np.cumsum(turn[:-1] & ~space) - 1  # the word of each byte that is no white space
    whole = np.zeros(len(word_first), bool)
    whole[which[kind == _OTHER]] = True
    parts = np.zeros(len(raw), bool)
    parts[1:] = kind[1:] != kind[:-1]
    if not spaces:
        parts |= kind == _DIGIT
    parts &= ~space
    inside = np.flatnonzero(parts)
    parts[inside[whole[which[inside]]]] = False
    alone = whole[which] & ~space if len(whole) else space & False
    parts[word_first] = True
    start = np.flatnonzero(parts)
    end = np.minimum(np.append(start[1:], len(raw)), word_last[which[start]])
    if not spaces:
        return start, end, alone
    ahead = word_first > 0
    ahead[ahead] = (raw[word_first[ahead] - 1] == 0x20) & ~edge[word_first[ahead]]
    start[np.searchsorted(start, word_first[ahead])] -= 1
    lo, hi = first[blank], last[blank]
    follows = ~edge[hi]  # a word stands behind the run
    rest = np.where(follows, hi - 1, hi)
    apart = follows & (raw[hi - 1] != 0x20)
    full = rest > lo
    start, end = np.concatenate([start, lo[full], hi[apart] - 1]), np.concatenate([end, rest[full], hi[apart]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], alone


class _Table:
    """Ids of units by hash; beyond its bounds it keeps the units that were met most."""

    def __init__(self) -> None:
        self.slot: dict[int, int] = {}
        self.hash = self.first = self.size = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: list[int]) -> np.ndarray:
        return np.array([-1 if x is None else x for x in map(self.slot.get, hashes)], np.int64)

    def add(self, hashes: list[int], ids: list[np.ndarray]) -> np.ndarray:
        at = len(self.hash) + np.arange(len(hashes))
        size = np.array([len(x) for x in ids], np.int64)
        self.slot.update(zip(hashes, at.tolist(), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.met = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(at), np.int64)])
        self.hash = np.concatenate([self.hash, np.array(hashes, np.uint64).astype(np.int64)])
        self.ids = np.concatenate([self.ids, *ids])
        return at

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units end to end, how many each has)."""
        size = self.size[slots]
        return self.ids[np.repeat(self.first[slots], size) + _ramp(size)], size

    def bound(self) -> None:
        if len(self.hash) <= TABLE and len(self.ids) <= TABLE_IDS:
            return
        order = np.argsort(-self.met, kind="stable")
        kept = order[: TABLE // 2][np.cumsum(self.size[order[: TABLE // 2]]) <= TABLE_IDS // 2]
        ids, size = self.ids_of(kept)
        self.ids, self.size, self.first = ids, size, np.cumsum(size) - size
        self.hash, self.met = self.hash[kept], self.met[kept] // 2
        self.slot = dict(zip(self.hash.astype(np.uint64).tolist(), range(len(kept)), strict=True))


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write bytes that are no printable Latin-1 characters as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts with one vocabulary file."""

    def __init__(self, path: str, kind: str = "space_first", leaf: int = 4096) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_padding()
        self.own.no_truncation()
        self.leaf, self.spaces, self.mark, self.table = leaf, kind == "space_first", _MARK[kind], _Table()
        (self.mark_id,) = self.own.encode(self.mark, add_special_tokens=False).ids
        names, special = self.own.get_vocab(with_added_tokens=True), self.own.get_added_tokens_decoder()
        chars = _byte_chars()
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = name.encode() if i in special else bytes(chars[c] for c in name if c in chars)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.special = {t.content: i for i, t in special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def leaves(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not halved; units that the table lacks go to the library as one text."""
        odd = [bool(_ODD.search(t)) for t in texts]
        whole, cut = iter(self.plain([t for t, x in zip(texts, odd, strict=True) if x])), [t.encode() for t, x in zip(texts, odd, strict=True) if not x]
        got: list[np.ndarray] = []
        lo = 0
        while lo < len(cut):
            hi, size = lo + 1, len(cut[lo])
            while hi < len(cut) and size + len(cut[hi]) <= AT_ONCE:
                size += len(cut[hi])
                hi += 1
            got += self._by_units(cut[lo:hi])
            lo = hi
        rest = iter(got)
        return [next(whole) if x else next(rest) for x in odd]

    def _by_units(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        start, end, alone = units(raw, at, self.spaces)
        body = raw if self.spaces else np.where(alone, raw, _folded(raw))
        hashes = span_hashes(body, start, end)
        long = np.flatnonzero(end - start > LONGEST)
        hashes[long] = np.arange(len(long), dtype=np.uint64)  # told apart by place; never kept
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names = keys.tolist()
        slots = self.table.find(names)
        slots[: np.searchsorted(keys, np.uint64(len(long)))] = -1
        missing = np.flatnonzero(slots < 0)
        data = body.tobytes()
        fresh = self._fresh([data[a:b].decode() for a, b in zip(start[where[missing]].tolist(), end[where[missing]].tolist(), strict=True)])
        kept = len(long)
        slots[missing] = self.table.add([names[k] for k in missing.tolist()], fresh)
        self.table.met[slots] += 1
        ids, size = self.table.ids_of(slots[inverse])
        if kept:
            self.table.met[slots[missing[:kept]]] = -1
            for k in range(kept):
                self.table.slot.pop(k, None)
        self.table.bound()
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, at)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _fresh(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each unit: units stand in one text between marks that are a token each."""
        mark, out = self.mark, [np.zeros(0, np.uint32)] * len(chunks)
        alone = [k for k, c in enumerate(chunks) if c.isspace() or mark in c]
        for k, ids in zip(alone, self.plain([chunks[k] for k in alone]), strict=True):
            out[k] = ids
        alone = set(alone)
        rest = [k for k in range(len(chunks)) if k not in alone]
        for lo in range(0, len(rest), 5000):
            some = rest[lo : lo + 5000]
            ids = self.plain([mark + mark.join([chunks[k] for k in some]) + mark])[0]
            at = np.flatnonzero(ids == self.mark_id)
            assert len(at) == len(some) + 1
            for k, a, b in zip(some, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[k] = ids[a + 1 : b]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: strings of special tokens, and trees of what stands between them."""
        split = [self._split(t) for t in texts]
        ids = iter(self._trees([part for parts in split for part in parts[::2]]))
        return [next(ids) if len(parts) == 1 else np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else next(ids) for k, p in enumerate(parts)]) for parts in split]

    def _split(self, text: str) -> list[str]:
        """What stands between strings of special tokens, and those strings, in turn."""
        return self.special_at.split(text) if any(s in text for s in self.special) else [text]

    def encode_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text for a vocabulary that drops white space: units stand alone."""
        split = [self._split(t) for t in texts]
        parts = [list(_lengths(part)) for some in split for part in some[::2]]
        got = iter(self.leaves([x for some in parts for x in some]))
        ids = iter([next(got) if len(some) == 1 else np.concatenate([next(got) for _ in some]) for some in parts])
        return [next(ids) if len(parts) == 1 else np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else next(ids) for k, p in enumerate(parts)]) for parts in split]

    def _trees(self, texts: list[str]) -> list[np.ndarray]:
        """Long texts are encoded as trees whose leaves, of all texts, go together."""
        bounds = [self._bounds(t) for t in texts]
        ids = iter(self.leaves([t[a:b] for t, cuts in zip(texts, bounds, strict=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        out = []
        for t, cuts in zip(texts, bounds, strict=True):
            parts = [(t[a:b], next(ids)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            while len(parts) > 1:
                parts = [self.join(*parts[k], *parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
            out.append(parts[0][1])
        return out

    def _bounds(self, text: str) -> list[int]:
        """Where leaves meet: even parts, and multiples of 64 where leaves are long, so that runs of one pattern agree."""
        if len(text) <= self.leaf:
            return [0, len(text)]
        n, even = 1 << (-(-len(text) // self.leaf) - 1).bit_length(), 64 if self.leaf >= 512 else 1
        return [len(text) * k // n // even * even for k in range(n)] + [len(text)]

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> tuple[str, np.ndarray]:
        """The encoding of both texts together."""
        size = 32
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            if a == 0 and b == len(right):
                return left + right, self.plain([left + right])[0]
            tail, head = left[a:], right[:b]
            begin, stop = self._before(tail, left_ids, a == 0), self._behind(head, right_ids, b == len(right))
            if begin and stop:
                (lo, i, begins), (hi, j, stops) = begin, stop
                window = self.plain([tail[lo:] + head[:hi]])[0]
                if (begins or _same(window[:2], left_ids[i : i + 2])) and (stops or _same(window[-2:], right_ids[max(j - 2, 0) : j])):
                    return left + right, np.concatenate([left_ids[:i], window, right_ids[j:]])
            size *= 2

    def _before(self, tail: str, ids: np.ndarray, whole: bool) -> tuple[int, int, bool] | None:
        """(place in the tail of the left text where a window may begin, tokens of the left text before it, whether splitting surely starts afresh there)."""
        starts = _char_starts(tail)
        back = np.concatenate([[0], np.cumsum(self.sizes[ids[::-1][: starts[-1] + 1]])])
        data = starts[-1] - back
        tokens = len(ids) - np.arange(len(back))
        places, tokens = data[data >= 0][::-1], tokens[data >= 0][::-1]
        chars = np.searchsorted(starts, places)
        met = starts[chars] == places
        found = dict(zip(chars[met].tolist(), tokens[met].tolist(), strict=True))
        afresh = next((k for k in range(len(tail) - 1, 0, -1) if _afresh(tail, k) and k in found), None)
        if afresh is not None:
            return afresh, found[afresh], True
        if whole:
            return 0, 0, True
        place = next((k for k in sorted(found) if k < len(tail) and _one_run(tail, k)), None)
        return None if place is None else (place, found[place], False)

    def _behind(self, head: str, ids: np.ndarray, whole: bool) -> tuple[int, int, bool] | None:
        """(place in the head of the right text where a window may end, tokens of the right text before it, whether splitting surely starts afresh there)."""
        starts = _char_starts(head)
        places = np.concatenate([[0], np.cumsum(self.sizes[ids[: starts[-1] + 1]])])
        places = places[places <= starts[-1]]
        chars = np.searchsorted(starts, places)
        met = starts[chars] == places
        found = dict(zip(chars[met].tolist(), np.flatnonzero(met).tolist(), strict=True))
        afresh = next((k for k in range(1, len(head)) if _afresh(head, k) and k in found), None)
        if afresh is not None:
            return afresh, found[afresh], True
        if whole:
            return len(head), len(ids), True
        place = next((k for k in sorted(found, reverse=True) if _one_run(head, k)), None)
        return None if place is None else (place, found[place], False)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _char_starts(text: str) -> np.ndarray:
    """The byte at which each character starts, and the bytes of the text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def _lengths(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Parts of a text, cut in front of white space about each ``most`` characters."""
    lo = 0
    while len(text) - lo > most:
        found = re.compile(r"[ \t-\r]").search(text, lo + most)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def _afresh(text: str, k: int) -> bool:
    """Whether splitting starts afresh at character ``k`` whatever stands around: white space behind anything else."""
    return text[k] in " \t\n\r\x0b\x0c" and not text[k - 1].isspace() and not _ODD.search(text[k - 1])


@cache
def _run_kind(c: str) -> str | None:
    """Letter, number, white space or sign; None for characters that are not the same in old and new versions of Unicode."""
    if c in " \t\n\r\x0b\x0c":
        return "Z"
    now = unicodedata.category(c)
    if _ODD.match(c) or now[0] in "ZC" or unicodedata.ucd_3_2_0.category(c) != now:
        return None
    return now[0] if now[0] in "LN" else "S"


def _one_run(text: str, k: int) -> bool:
    """Whether the characters around ``k`` are one run that splitting can't part there: three before (an ending such as
    's is shorter) and three behind."""
    kinds = {_run_kind(c) for c in text[k - 3 : k + 3]} if 3 <= k <= len(text) - 3 else {None}
    return len(kinds) == 1 and None not in kinds


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    return len(a) == len(b) and bool((a == b).all())


@cache
def encoder(path: str, kind: str = "space_first", leaf: int = 4096) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, kind, leaf)


def encoded(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = 4096) -> DataFrame:
    """``ids`` of each text, and ``decoded``, the text that they give."""

    def make() -> Callable[[pa.Array], dict]:
        own = encoder(path, "space_first", leaf)

        def run(texts: pa.Array) -> dict:
            ids = own.encode(pc.fill_null(texts, "").to_pylist())
            return {"ids": [x.astype(np.int32) for x in ids], "decoded": [own.decode(x) for x in ids]}

        return run

    return annotated(df, text, list(keep), make, "ids array<int>, decoded string")


def encoding_digests(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = 4096) -> DataFrame:
    """What encoded() gives, as a count and digests: the ids need not leave the task."""

    def make() -> Callable[[pa.Array], dict]:
        own = encoder(path, "space_first", leaf)

        def one(ids: np.ndarray) -> Iterator:
            yield len(ids)
            yield hashlib.sha256(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest()
            yield hashlib.sha256(own.decode(ids).encode()).hexdigest()

        def run(texts: pa.Array) -> dict:
            rows = [tuple(one(x)) for x in own.encode(pc.fill_null(texts, "").to_pylist())]
            return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows, strict=True), strict=True))

        return run

    return annotated(df, text, list(keep), make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
