"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of tokens end together.

Side A is a byte-level BPE over space + text, side B a sentencepiece model over the text, which adds the space; strings of
special tokens inside texts are plain text on both sides. Cumulative ends of both sides' tokens are merged; bytes at which
both end cut the tokens into groups, and each such byte links the A token and the B token that end there.

Of two tokens that end at one byte the shorter one's bytes are the end of the longer one's, and a token of n bytes has at
most n ends: the number of different pairs is at most the bytes of both vocabularies (some 600,000 for 50,000 and 32,000
tokens), whatever the corpus. Counts of pairs, and the maxima of each side, are therefore broadcast back to the documents.

B's pieces never have a space behind anything else, and none has a line break, so a text is parted there exactly (a
vocabulary that does is refused); the ids of these units are kept in a bounded table of each worker, found by a 64-bit hash of units up
to 48 bytes (two units of one hash would share ids, a chance of about 1e-9 a worker).

Null and empty texts, and texts that either side changes (such as those with U+2581), have no tokens: counts of 0 and an
empty digest. Each row is aligned by itself, whatever its id; repeated rows count each time, as their text stands there
twice. A long text makes a piece of its own, merged in blocks of groups. An empty table gives an empty one. A returned
column takes the place of a kept one of its name; the table of a row's pairs has columns of its own (``align__``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._batches import annotated, bytes_of
from ._words import _ramp, span_hashes
from .tree_bpe import LONGEST, Encoder, _Table

#: Groups that are written out at once.
BLOCK = 1 << 18


class _Side:
    """Bytes and decimal numbers of a vocabulary as arrays."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        width = len(str(max(len(pieces) - 1, 1)))
        self.decimal = np.frombuffer(b"".join(str(i).encode().rjust(width, b"\0") for i in range(len(pieces))), np.uint8).reshape(-1, width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.first[ids], size) + _ramp(size)]


class _Plain(Encoder):
    """Side A: strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.own.encode_special_tokens = True
        self.special = {}
        self.side = _Side(self.bytes)


class _Pieces:
    """Side B."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own, self.table = sentencepiece.SentencePieceProcessor(model_file=path), _Table()
        names = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.side = _Side([bytes([int(n[3:5], 16)]) if self.own.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        if any("▁" in n.lstrip("▁") for n in names) or any("\n" in n for n in names):
            raise ValueError(f"{path}: a piece goes over a space or a line break")
        self.space = np.array([self.own.piece_to_id("▁")], np.uint32)
        #: Bytes that no piece has beside others.
        self.alone = np.isin(np.arange(256), [ord(c) for c in "\n\t\r" if not any(c in n and len(n) > 1 for n in names)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; all begin with the space that the model adds."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        space, alone = raw == 0x20, self.alone[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[at[:-1][at[:-1] < len(raw)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        hashes = span_hashes(raw, start, end)
        long = np.flatnonzero(end - start > LONGEST)
        hashes[long] = np.arange(len(long), dtype=np.uint64)  # told apart by place; never kept
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names = keys.tolist()
        slots = self.table.find(names)
        slots[: np.searchsorted(keys, np.uint64(len(long)))] = -1
        missing = np.flatnonzero(slots < 0)
        data = raw.tobytes()
        fresh = self._fresh([data[a:b].decode() for a, b in zip(start[where[missing]].tolist(), end[where[missing]].tolist(), strict=True)])
        slots[missing] = self.table.add([names[k] for k in missing.tolist()], fresh)
        self.table.met[slots] += 1
        ids, size = self.table.ids_of(slots[inverse])
        for k in range(len(long)):
            self.table.slot.pop(k, None)
        self.table.met[slots[missing[: len(long)]]] = -1
        self.table.bound()
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, at)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _fresh(self, units: list[str]) -> list[np.ndarray]:
        """The model adds a space: it stands for a unit's own first one, or before a line break ahead of any other unit."""
        own = [u[0] == " " for u in units]
        got = self.own.encode([u[1:] if x else "\n" + u for u, x in zip(units, own, strict=True)], num_threads=1)
        # A space alone is nothing to the model.
        return [np.array(ids if x else ids[2:], np.uint32) if ids else self.space for ids, x in zip(got, own, strict=True)]


@cache
def _sides(path_a: str, path_b: str) -> tuple[_Plain, _Pieces]:
    """One pair of encoders for each worker process."""
    return _Plain(path_a), _Pieces(path_b)


class Alignment:
    """Tokens of a piece of texts on both sides, end to end, and the groups that they are cut into."""

    def __init__(self, texts: pa.Array, a: _Plain, b: _Pieces) -> None:
        raw, at = bytes_of(texts)
        full = np.diff(at) > 0
        ids = [np.zeros(0, np.uint32)] * len(full)
        body = [b" " + raw[x:y].tobytes() for x, y in zip(at[:-1][full].tolist(), at[1:][full].tolist(), strict=True)]
        ids_a, ids_b = ids.copy(), ids.copy()
        for k, data, x, y in zip(np.flatnonzero(full).tolist(), body, a.encode([d.decode() for d in body]), b.encode(body), strict=True):
            if _spells(a.side, x, data) and _spells(b.side, y, data):
                ids_a[k], ids_b[k] = x, y
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64) for some in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([*some, np.zeros(0, np.uint32)]).astype(np.int64) for some in (ids_a, ids_b))
        end_a, end_b = np.cumsum(a.side.size[self.a]), np.cumsum(b.side.size[self.b])
        # The merge: a byte is an end of one side, the other, or both.
        ends = np.zeros((2, (int(end_a[-1]) if len(end_a) else 0) + 1), bool)
        ends[0, end_a] = True
        ends[1, end_b] = True
        self.last_a, self.last_b = np.flatnonzero(ends[1, end_a]), np.flatnonzero(ends[0, end_b])
        #: The groups of each text, one more entry at the end.
        self.first = np.searchsorted(self.last_a, self.first_a)
        self.sides = a.side, b.side

    def digests(self) -> list[str]:
        """Of each text, groups written as a1,a2|b1;a3|b2,b3 in decimal ids; '' without tokens."""
        texts = len(self.first) - 1
        hashers = {}
        for lo in range(0, len(self.last_a), BLOCK):
            hi = min(lo + BLOCK, len(self.last_a))
            a0, b0 = (int(x[lo - 1]) + 1 if lo else 0 for x in (self.last_a, self.last_b))
            a1, b1 = int(self.last_a[hi - 1]) + 1, int(self.last_b[hi - 1]) + 1
            behind_a, behind_b = self.last_a[lo:hi] + 1 - a0, self.last_b[lo:hi] + 1 - b0
            begin_a, begin_b = np.append(0, behind_a[:-1]), np.append(0, behind_b[:-1])
            # The tokens of A stand behind all of B's earlier groups, those of B behind A's groups up to their own.
            place_a = np.arange(a1 - a0) + np.repeat(begin_b, behind_a - begin_a)
            place_b = np.arange(b1 - b0) + np.repeat(behind_a, behind_b - begin_b)
            side_a, side_b = self.sides
            width = 1 + max(side_a.decimal.shape[1], side_b.decimal.shape[1])
            out = np.zeros((len(place_a) + len(place_b), width), np.uint8)
            out[:, 0] = ord(",")
            out[place_a, width - side_a.decimal.shape[1] :] = side_a.decimal[self.a[a0:a1]]
            out[place_b, width - side_b.decimal.shape[1] :] = side_b.decimal[self.b[b0:b1]]
            group = place_a[begin_a]
            out[group, 0] = ord(";")
            out[place_b[begin_b], 0] = ord("|")
            k0, k1 = int(np.searchsorted(self.first, lo, side="right")) - 1, int(np.searchsorted(self.first, hi))
            some = [k for k in range(k0, min(k1, texts)) if self.first[k + 1] > max(self.first[k], lo) and self.first[k] < hi]
            heads = [int(group[self.first[k] - lo]) for k in some if self.first[k] >= lo]
            out[heads, 0] = 0
            line = out.reshape(-1)
            mark = line != 0
            cuts = [int(group[max(self.first[k], lo) - lo]) for k in some] + [len(out)]
            size = np.concatenate([[0], np.cumsum(mark.reshape(-1, width).sum(axis=1))])[cuts]
            line = line[mark]
            for k, x, y in zip(some, size[:-1].tolist(), size[1:].tolist(), strict=True):
                hashers.setdefault(k, hashlib.sha256()).update(line[x:y])
        return [hashers[k].hexdigest() if k in hashers else "" for k in range(texts)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of each text, pairs as a * (tokens of B) + b, how many links of the text hold them)."""
        many_b = len(self.sides[1].size)
        most = len(self.sides[0].size) * many_b
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys, times = np.unique(text * most + self.a[self.last_a] * many_b + self.b[self.last_b], return_counts=True)
        return np.searchsorted(keys, np.arange(len(self.first)) * most), keys % most, times


def _spells(side: _Side, ids: np.ndarray, data: bytes) -> bool:
    """Whether the tokens' bytes are the text's."""
    if int(side.size[ids].sum()) != len(data):
        return False
    at = 0
    for lo in range(0, len(ids), BLOCK):
        some = side.joined(ids[lo : lo + BLOCK])
        if some.tobytes() != data[at : at + len(some)]:
            return False
        at += len(some)
    return True


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of both sides (``a_ids``, ``b_ids``) and, for each group in order, its last token on either side by place in the
    text (``a_last``, ``b_last``); these two are also the group's link."""

    def make() -> Callable[[pa.Array], dict]:
        sides = _sides(path_a, path_b)

        def run(texts: pa.Array) -> dict:
            got = Alignment(texts, *sides)
            spread = np.diff(got.first)
            return {
                "a_ids": _lists(got.first_a, got.a, pa.int32()), "b_ids": _lists(got.first_b, got.b, pa.int32()),
                "a_last": _lists(got.first, got.last_a - np.repeat(got.first_a[:-1], spread), pa.int32()), "b_last": _lists(got.first, got.last_b - np.repeat(got.first_b[:-1], spread), pa.int32()),
            }

        return run

    return annotated(df, text, list(keep), make, "a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def linked(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and a digest of each text's groups, and its pairs with how many links hold them."""

    def make() -> Callable[[pa.Array], dict]:
        sides = _sides(path_a, path_b)

        def run(texts: pa.Array) -> dict:
            got = Alignment(texts, *sides)
            offsets, pair, times = got.pairs()
            groups = np.diff(got.first)
            return {"n_a": np.diff(got.first_a), "n_b": np.diff(got.first_b), "n_groups": groups, "n_links": groups, "groups_sha256": got.digests(), "align__pair": _lists(offsets, pair, pa.int64()), "align__times": _lists(offsets, times, pa.int64())}

        return run

    return annotated(df, text, list(keep), make, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, align__pair array<bigint>, align__times array<bigint>")


def pair_counts(links: DataFrame, many_b: int) -> DataFrame:
    """For each pair of ids its count over the corpus, and whether no pair of its A id, or of its B id, has a higher one."""
    each = links.select(F.explode(F.arrays_zip("align__pair", "align__times")).alias("p"))
    counts = _store.written(each.groupBy(F.col("p.align__pair").alias("pair")).agg(F.sum("p.align__times").alias("count")), "pairs", rows=None)
    counts = counts.select("pair", "count", F.expr(f"pair div {many_b}").alias("a"), (F.col("pair") % many_b).alias("b"))
    for side in ("a", "b"):
        best = counts.groupBy(F.col(side).alias("__of")).agg(F.max("count").alias("__most"))
        counts = counts.join(F.broadcast(best), F.col(side) == F.col("__of")).withColumn(f"best_{side}", F.col("count") == F.col("__most")).drop("__of", "__most")
    return counts


def alignment_digests(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of each row its counts and digest; ``n_best``: links whose pair has the highest count of its B id, ``n_mutual``: and
    of its A id; ``count_sum``: the sum of its links' counts."""
    import sentencepiece

    many_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    links = _store.written(linked(df, path_a, path_b, text, keep), "links")
    rows = links.withColumn("align__row", F.monotonically_increasing_id())
    own = [c for c in rows.columns if c not in ("align__pair", "align__times")]
    each = rows.select(*own, F.explode_outer(F.arrays_zip("align__pair", "align__times")).alias("align__p"))
    each = each.select(*own, F.col("align__p.align__pair").alias("align__pair"), F.col("align__p.align__times").alias("align__times"))
    counts = pair_counts(links, many_b).select(F.col("pair").alias("align__pair"), F.col("count").alias("align__count"), F.col("best_b").alias("align__best"), (F.col("best_a") & F.col("best_b")).alias("align__mutual"))
    back = each.join(F.broadcast(counts), "align__pair", "left")
    times = F.col("align__times")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
    summed = back.groupBy(*own).agg(total(F.when(F.col("align__best"), times)).alias("n_best"), total(F.when(F.col("align__mutual"), times)).alias("n_mutual"), total(times * F.col("align__count")).alias("count_sum"))
    return summed.drop("align__row")
