"""LM scoring: subword lattice likelihood.

The pieces of an existing vocabulary weight all segmentations of a text; a forward recursion in log space sums them to
the text's marginal probability. Pieces that start a word carry the word mark, so a piece sequence has one text: words,
each a lattice of its own, and one end. Every byte is a piece, so every text has a probability.

The vocabulary's own scores (ranks) give the first weights; expectation-maximisation over the distinct words of the
training documents sets them anew, each round a job over the table of words whose result is one number for each piece,
until the likelihood of the words gains less than ``tolerance`` of itself.
A training word is also a piece of its own, one arc over the whole lattice, with its count less a discount as its
weight; the discounts of all words are the weight of the way through the vocabulary's pieces. So a word has c - d of N for
itself and a share of d * V of N by its pieces. The discount d is the likeliest for the training tokens when each is left
out of the counts that score it, which counts of counts tell.

Word counts grow with the corpus and stay a table. The most frequent words, at most ``head_words`` of ``head_bytes`` in
all, are broadcast, but for words of over a 64th of ``head_bytes`` each; every other word of a document is joined with
the table, so scores are exact for all words.

Null and empty texts have the end alone. An empty table gives no rows. Rows of one id or one text are scored each on its
own; equal texts have equal scores. A document without an id counts as held out. Other columns, whatever their names, are
not read. With no training text all pieces keep their first weights and every base probability is that of an unknown token.
Words of at most WIDE bytes are scored many at a time. A longer one, such as a text without white space, is scored on its
own in spans of SPAN bytes, each of which takes over the sums of the last places before it: memory is bounded by a span
(and the word's bytes), time grows with the word, some two microseconds a byte for each recursion.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces
from ._store import written
from ._words import mixed

_RNG = np.random.Generator(np.random.PCG64(77))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
MARK = b" "

#: Bytes of a word up to which words are scored many at a time, and of a span of a longer one.
WIDE, SPAN = 2_048, 1 << 16


class Lattice:
    """Pieces as bytes and their log weights; words are scored many at a time."""

    def __init__(self, names: list[bytes], weights: np.ndarray) -> None:
        self.names, self.weights = names, weights
        self.longest = max(map(len, names))
        keys = np.zeros(len(names), np.uint64)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        for length in range(1, self.longest + 1):
            at = np.flatnonzero(sizes == length)
            block = np.frombuffer(b"".join([names[k] for k in at.tolist()]), np.uint8).reshape(len(at), length)
            for k in range(length):
                keys[at] = keys[at] * _STEP + _BYTE[block[:, k]]
        keys = mixed(keys)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def _arcs(self, block: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(word, start, piece, length) of each piece that fits somewhere, by length."""
        n, width = block.shape
        h, out = np.zeros((n, width), np.uint64), []
        letters = _BYTE[block]
        for length in range(1, min(self.longest, width) + 1):
            last = width - length + 1
            h = h[:, :last] * _STEP + letters[:, length - 1 :]
            key = mixed(h)
            word, start = np.nonzero(self.maybe[key >> np.uint64(42)])
            inside = start + length <= sizes[word]
            word, start = word[inside], start[inside]
            key = key[word, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out.append((word[found], start[found], self.order[at[found]], length))
        return out

    def _dense(self, arcs: list, shape: tuple[int, int], ends: bool) -> list[np.ndarray]:
        """For each length, the weight of the piece that starts (ends) at each place, minus infinity where none does."""
        out = []
        for word, start, piece, length in arcs:
            w = np.full(shape, -np.inf)
            w[word, start + length if ends else start] = self.weights[piece]
            out.append(w)
        return out

    def forward(self, block: np.ndarray, sizes: np.ndarray, arcs: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log sums over the segmentations of each prefix, those of the whole words)."""
        n, width = block.shape
        arcs = self._arcs(block, sizes) if arcs is None else arcs
        into = self._dense(arcs, (n, width + 1), ends=True)
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            terms = np.stack([alpha[:, j - k] + into[k - 1][:, j] for k in range(1, min(j, len(into)) + 1)])
            alpha[:, j] = _logsum(terms)
        return alpha, alpha[np.arange(n), sizes]

    def _span(self, word: bytes, lo: int, hi: int, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, first arc of each place and one past the last) of a marked word's arcs that end in (lo, hi], ordered by end, or start in [lo, hi), ordered by start."""
        ends = by == "end"
        first, last = (max(0, lo - self.longest + 1), hi) if ends else (lo, min(len(word), hi + self.longest - 1))
        block = np.frombuffer(word, np.uint8, last - first, first)[None]
        arcs = self._arcs(block, np.array([last - first]))
        start = np.concatenate([a[1] for a in arcs]) + first
        size = np.concatenate([np.full(len(a[1]), a[3]) for a in arcs])
        piece = np.concatenate([a[2] for a in arcs])
        key = start + size - 1 if ends else start
        order = np.argsort(key, kind="stable")
        order = order[(key[order] >= lo) & (key[order] < hi)]
        bounds = np.searchsorted(key[order], np.arange(lo, hi + 1))
        return start[order], (start + size)[order], piece[order], bounds

    def _onward(self, word: bytes, lo: int, hi: int, before: list[float], arcs: tuple) -> list[float]:
        """Log sums of the places from lo - len(before) + 1 to hi; ``before`` are those up to lo."""
        start, _, piece, bounds = arcs
        sums, shift = list(before), lo - len(before) + 1
        _sweep(sums, (start - shift).tolist(), self.weights[piece].tolist(), bounds.tolist())
        return sums

    def _long_forward(self, word: bytes, span: int) -> tuple[list[list[float]], float]:
        """(log sums of the last places up to each span's start, log sum of the whole marked word)."""
        kept, before = [], [0.0]
        for lo in range(0, len(word), span):
            hi = min(lo + span, len(word))
            kept.append(before)
            before = self._onward(word, lo, hi, before, self._span(word, lo, hi, "end"))[-self.longest :]
        return kept, before[-1]

    def _long_expected(self, word: bytes, count: float, total: np.ndarray, span: int) -> float:
        """Adds the expected uses of each piece in one marked word to ``total``; its log likelihood."""
        kept, whole = self._long_forward(word, span)
        after = [0.0]  # log sums from a place to the word's end, the nearest place last
        for k in range(len(kept) - 1, -1, -1):
            lo, hi = k * span, min((k + 1) * span, len(word))
            alpha = np.array(self._onward(word, lo, hi, kept[k], self._span(word, lo, hi, "end")))[len(kept[k]) - 1 :]
            start, end, piece, bounds = self._span(word, lo, hi, "start")
            beta, far = list(after), hi + len(after) - 1
            _sweep(beta, (far - end)[::-1].tolist(), self.weights[piece][::-1].tolist(), (bounds[-1] - bounds[::-1]).tolist())
            share = np.exp(alpha[start - lo] + self.weights[piece] + np.array(beta)[far - end] - whole)
            total += np.bincount(piece, share * count, len(total))
            after = beta[-self.longest :]
        return whole * count

    def expected(self, words: list[bytes], counts: np.ndarray, wide: int = WIDE, span: int = SPAN) -> tuple[np.ndarray, float]:
        """(expected uses of each piece over all segmentations of the words, log likelihood of the words)."""
        total, likelihood = np.zeros(len(self.names)), 0.0
        short, long = _by_width(words, wide)
        for k in long:
            likelihood += self._long_expected(MARK + words[k], float(counts[k]), total, span)
        counts = counts[short]
        for at, block, sizes in _blocks([words[k] for k in short]):
            n, width = block.shape
            arcs = self._arcs(block, sizes)
            alpha, whole = self.forward(block, sizes, arcs)
            onward = self._dense(arcs, (n, width + 1), ends=False)
            beta = np.full((n, width + len(onward) + 1), -np.inf)
            beta[np.arange(n), sizes] = 0
            for i in range(width - 1, -1, -1):
                terms = np.stack([beta[:, i + k] + onward[k - 1][:, i] for k in range(1, len(onward) + 1)] + [beta[:, i]])
                beta[:, i] = _logsum(terms)
            for word, start, piece, length in arcs:
                share = np.exp(alpha[word, start] + self.weights[piece] + beta[word, start + length] - whole[word])
                total += np.bincount(piece, share * counts[at[word]], len(total))
            likelihood += float((whole * counts[at]).sum())
        return total, likelihood

    def log_probabilities(self, words: list[bytes], wide: int = WIDE, span: int = SPAN) -> np.ndarray:
        out = np.empty(len(words))
        short, long = _by_width(words, wide)
        for k in long:
            out[k] = self._long_forward(MARK + words[k], span)[1]
        for at, block, sizes in _blocks([words[k] for k in short]):
            out[short[at]] = self.forward(block, sizes)[1]
        return out


def _by_width(words: list[bytes], wide: int) -> tuple[np.ndarray, list[int]]:
    """Places of the words of at most ``wide`` bytes, and of the others."""
    long = np.fromiter(map(len, words), np.int64, len(words)) > wide
    return np.flatnonzero(~long), np.flatnonzero(long).tolist()


def _sweep(sums: list[float], at: list[int], weights: list[float], bounds: list[int]) -> None:
    """Appends one log sum for each place: over its arcs, that of the place an arc comes from and the arc's weight. Every byte is a piece, so a place has an arc."""
    exp, log = math.exp, math.log
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        if b - a == 1:
            sums.append(sums[at[a]] + weights[a])
            continue
        terms = [sums[i] + w for i, w in zip(at[a:b], weights[a:b], strict=True)]
        top = max(terms)
        sums.append(top + log(sum([exp(t - top) for t in terms])))


def _logsum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe).sum(0))


def _blocks(words: list[bytes], cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, bytes of marked words a row each, their lengths): words of like length together."""
    raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    along = sizes[order] + 1
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(along, along[lo] + along[lo] // 8, side="right"))
        hi = min(hi, lo + max(1, cells // int(along[hi - 1])))
        at = order[lo:hi]
        place = np.arange(int(along[hi - 1]) - 1)
        block = np.full((hi - lo, len(place) + 1), MARK[0], np.uint8)
        inside = place < sizes[at][:, None]
        block[:, 1:] = np.where(inside, raw[np.where(inside, starts[at][:, None] + place, 0)], 0)
        yield at, block, along[lo:hi]
        lo = hi


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Distinct pieces that can stand in a marked word, as bytes, and first log weights by the file's ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            continue
        raw = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.encode().replace("▁".encode(), MARK)
        if MARK in raw[1:] or raw == b"":
            continue
        rank = model.get_piece_size() if model.is_byte(i) else min(-model.get_score(i), model.get_piece_size())
        best[raw] = max(best.get(raw, 0), 1 / (rank + 10))
    for b in range(256):
        best.setdefault(bytes([b]), 1e-6)
    weights = np.log(np.array(list(best.values())))
    return list(best), weights - np.log(np.exp(weights).sum())


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame, hold: int = 64 << 20, cost: int = 150) -> DataFrame:
    """(word, c): every word of columns train, text, and how often training texts have it; the empty word is the end.

    A task holds at most about ``hold`` bytes of words, each at its length and ``cost``, beyond those of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, other, held, known = Counter(), set(), 0, 0

        def out() -> pa.RecordBatch:
            rest = list(other - seen.keys())
            return pa.RecordBatch.from_arrays([pa.array([*seen, *rest], pa.binary()), pa.array([*seen.values(), *[0] * len(rest)], pa.int64())], names=["word", "c"])

        for piece in pieces(batches, "text"):
            for train, text in zip(piece.column("train").to_pylist(), piece.column("text").to_pylist(), strict=True):
                if train:
                    seen.update(_words(text))
                    seen[b""] += 1
                else:
                    other.update(_words(text))
            # what the piece can have added: its new words, none of more bytes than the whole piece
            held += piece.column("text").nbytes if len(seen) + len(other) > known else 0
            known = len(seen) + len(other)
            if known * cost + held > hold:
                held = sum(map(len, seen)) + sum(map(len, other))
            if known * cost + held > hold:
                yield out()
                seen.clear()
                other.clear()
                held = known = 0
        yield out()

    return docs.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def trained(counts: DataFrame, names: list[bytes], weights: np.ndarray, rounds: int = 8, tolerance: float = 0.01, floor: float = 0.01) -> np.ndarray:
    """Log weights of the pieces by expectation-maximisation over the distinct training words, for at most ``rounds``."""
    spark = counts.sparkSession
    train = counts.where("c > 0 AND length(word) > 0").select("word")
    before = -np.inf
    for _ in range(rounds):
        given = spark.sparkContext.broadcast((names, weights))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            lattice, total, likelihood = Lattice(*given.value), np.zeros(len(given.value[0])), 0.0
            for piece in pieces(batches, "word", 1 << 19):
                uses, gain = lattice.expected(piece.column("word").to_pylist(), np.ones(piece.num_rows))
                total, likelihood = total + uses, likelihood + gain
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], likelihood))], names=["piece", "uses"])

        got = {r["piece"]: r["uses"] for r in train.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        given.unpersist()
        likelihood = got.pop(-1, 0.0)
        if not got:
            break
        uses = np.full(len(names), floor)
        uses[list(got)] += list(got.values())
        weights = np.log(uses / uses.sum())
        if likelihood - before < tolerance * abs(likelihood):
            break
        before = likelihood
    return weights


def discount(counts: DataFrame) -> float:
    """The part of a count c that words give away for which the training tokens are likeliest when each is left out.

    A word seen once is then unseen, with d of its own for it; a word seen c times has c - 1 - d.
    """
    grid = [k / 100 for k in range(1, 100)]
    each = counts.groupBy(F.col("c").cast("double").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    again = [F.sum(F.when(F.col("c") > 1, F.col("n") * F.col("c") * F.log(F.greatest("c", F.lit(2.0)) - 1 - d))) for d in grid]
    once, *gains = each.agg(F.sum(F.when(F.col("c") == 1, F.col("n"))), *again).first()
    if not once or gains[0] is None:
        return 0.5
    return grid[int(np.argmax([once * np.log(d) + g for d, g in zip(grid, gains, strict=True)]))]


def scored(df: DataFrame, path: str, doc: str = "doc_id", text: str = "text", held_mod: int = 10, head_words: int = 250_000, head_bytes: int = 4_000_000, rounds: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; trained where crc32(doc_id) mod ``held_mod`` is not 0."""
    spark = df.sparkSession
    held = F.crc32(F.coalesce(df[doc].cast("string"), F.lit(""))) % held_mod == 0
    docs = df.select(df[doc].alias("doc_id"), df[text].cast("string").alias("text"), (~held).alias("train"))
    counts = written(word_counts(docs), "words")
    about = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    n, v, ends = (int(about[k] or 0) for k in ("n", "v", "ends"))
    less = discount(counts.where("c > 0 AND length(word) > 0"))
    names, weights = vocabulary(path)
    weights = trained(counts, names, weights, rounds)
    model = spark.sparkContext.broadcast((names, weights))
    by_pieces = (less * (v - (ends > 0)) + 1) / (n + 2)  # the least mass of unseen words and of the end is that of one token

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for piece in pieces(batches, "word", 1 << 19):
            c = piece.column("c").to_numpy()
            own = np.log10(np.maximum(c - less, 1e-300) / (n + 2), where=c > 0, out=np.full(len(c), -np.inf))
            parts = lattice.log_probabilities(piece.column("word").to_pylist()) / np.log(10) + np.log10(by_pieces)
            top = np.maximum(own, parts)
            yield pa.RecordBatch.from_arrays([piece.column("word"), piece.column("c"), pa.array(top + np.log10(1 + 10 ** (np.minimum(own, parts) - top)))], names=["word", "c", "log_p"])

    rated = written(counts.where("length(word) > 0").mapInArrow(rate, "word binary, c bigint, log_p double"), "rated-words")
    may = rated.where((F.col("c") > 1) & (F.length("word") <= head_bytes // 64))
    steps = may.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("bytes"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, words_left, bytes_left = None, head_words, head_bytes
    for s in steps:
        words_left, bytes_left = words_left - s["words"], bytes_left - s["bytes"]
        if words_left < 0 or bytes_left < 0:
            break
        least = s["least"]
    top = may.where(F.col("c") >= least).collect() if least else []
    head = spark.sparkContext.broadcast(([bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64), np.array([r["log_p"] for r in top], np.float64)))

    kind = pa.schema([("row", pa.int64()), ("doc_id", _kind(docs)), ("held_out", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    base_end, score_end = float(np.log10(ends + 0.1)), float(np.log10((ends + 1) / (n + 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, log_p = head.value
        find = {w: k for k, w in enumerate(words)}
        log_c = np.append(np.log10(c + 0.1), 0.0)
        log_p = np.append(log_p, 0.0)
        row = TaskContext.get().partitionId() << 34
        for piece in pieces(batches, "text"):
            rows, texts, keys, held_out, tails, rest = [], [], [], [], [], []
            for k, (train, text) in enumerate(zip(piece.column("train").to_pylist(), piece.column("text").to_pylist(), strict=True)):
                own = _words(text)
                at = np.array([find.get(w, -1) for w in own], np.int64)
                row += 1
                texts.append((len(own) + 1, int((at >= 0).sum()) + (ends > 0), float(log_c[at].sum()) + base_end, float(log_p[at].sum()) + score_end))
                rows.append(row)
                held_out.append(not train)
                keys.append(k)
                for w, m in Counter([own[j] for j in np.flatnonzero(at < 0)]).items():
                    tails.append(row)
                    rest.append((w, m))
            more = len(tails)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows + tails, pa.int64()),
                pa.concat_arrays([piece.column("doc_id").take(pa.array(keys, pa.int64())), pa.nulls(more, kind.field("doc_id").type)]),
                pa.array(held_out + [None] * more, pa.bool_()),
                pa.array([None] * len(rows) + [w for w, _ in rest], pa.binary()),
                pa.array([t[0] for t in texts] + [m for _, m in rest], pa.int64()),
                pa.array([t[1] for t in texts] + [None] * more, pa.int64()),
                pa.array([t[2] for t in texts] + [None] * more, pa.float64()),
                pa.array([t[3] for t in texts] + [None] * more, pa.float64()),
            ], schema=kind)

    parts = docs.mapInArrow(run, f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, word binary, n bigint, known bigint, base double, score double")
    parts = written(parts, "scored-parts")
    known = F.when(F.col("c") > 0, F.col("n")).otherwise(0)
    tail = parts.where("word IS NOT NULL").select("row", "word", "n").join(rated, "word")
    tail = tail.select("row", F.lit(0).cast("bigint").alias("n"), known.alias("known"), (F.col("n") * F.log10(F.col("c") + 0.1)).alias("base"), (F.col("n") * F.col("log_p")).alias("score"))
    tail = tail.groupBy("row").agg(F.sum("known").alias("t_known"), F.sum("base").alias("t_base"), F.sum("score").alias("t_score"))
    whole = parts.where("word IS NULL").join(tail, "row", "left")
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return whole.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", F.lit(0.0)) - F.col("n") * norm).alias("base_score"), (F.col("score") + F.coalesce("t_score", F.lit(0.0))).alias("score"),
    )


def _kind(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
