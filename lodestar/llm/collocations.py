"""Collocations of two to four words by language: sketched upper bounds, automata that count, exact thresholds.

Texts have A-Z in lower case; they are split at any of ``.,;:!?`` and bytes 10 to 13 into pieces, and those at spaces and
tabs into words. All is counted by language (null: ``und``).

1. Sketch. Each task hashes the words and pairs of words of its texts to the cells of one wide array and counts them; Spark
   sums the counts block of cells by block. A phrase has at most its cell's count, so a bit a cell says which phrases may
   reach ``min_count``. A second round does the same for runs of three and four words whose pairs all may. The array grows
   with the texts, about a cell for each two words, up to 2^29 cells: the bits are at most 64 MB, a proven bound for what is
   broadcast. Beyond it the bounds are looser and more phrases are counted; no result changes.
2. Automata. Texts are read in shards of bounded bytes, language by language. The runs of a shard that may be frequent
   compile into an automaton of phrases with a space before and behind each, a guard that no part of a word passes; it scans
   the shard and counts matches, overlapping ones too. As an automaton has what its own shard holds, it is bounded by it,
   however many candidates the corpus has. A shard hands on a phrase with the matches at which none of its longer candidates
   begins: each word begins one such match at most, so rows are at most one for each word. Texts are dealt by ranges of
   language first, and a task sums the rows of its shards before it hands them on, as many as a bound of bytes holds: a row
   is a phrase of a task, and tasks with one language each have few phrases that are not the other tasks' too.
3. Sums of the tasks' rows by language and phrase, and of those over the phrases that begin with a phrase, are its exact
   counts; thresholds, cuts and rules about longer phrases are joins.

A text of any length is read in chunks; a piece longer than a chunk is cut between words with three words in both parts, and
what these three have in both is counted off once. Null and empty texts, and texts of delimiters alone, have no words. Ids
play no part: repeated rows count each time. Equal scores go by ``a`` and then by the phrase's bytes. An empty table gives
an empty one. Only columns ``text`` and ``lang`` are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store
from ._batches import pieces, release
from ._words import mixed, span_hashes

#: Words of the longest phrase; cells of a block; least and most bits of a cell's number; bytes of texts that make a shard.
LONGEST, BLOCK, LEAST_BITS, MOST_BITS, SHARD = 4, 1 << 16, 18, 29, 8 << 20
#: Cells, and bytes of phrases with their counts, that a task gathers before it hands them on; bytes of texts of a task.
HOLD, HOLD_BYTES, TASK = 1 << 23, 32 << 20, 256 << 20
_PRIME = np.uint64(0x8CB92BA72F3D8DD7)
_TO = bytes(0x20 if b == 0x09 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACES = re.compile(rb" {2,}")


def guarded(texts: list[bytes]) -> bytes:
    """The texts' words, each between single spaces; a line break as a word of its own parts pieces."""
    return _SPACES.sub(b" ", b" \n " + b"\n".join(texts).translate(_TO).replace(b"\n", b" \n ") + b" \n ")


def chunks(data: bytes, most: int = SHARD) -> Iterator[tuple[bytes, bytes]]:
    """Guarded texts in chunks cut between pieces or, in a longer piece, words: (chunk, the words that the next one has too)."""
    lo = 0
    while len(data) - lo > most:
        hi = data.rfind(b" \n ", lo + 1, lo + most)
        if hi > lo:
            yield data[lo : hi + 1], b""
            lo = hi
            continue
        hi = lo
        for _ in range(LONGEST):  # words of nearly a chunk's length
            hi = data.find(b" ", hi + 1)
            if hi < 0:
                yield data[lo:], b""
                return
        back = hi = max(hi, data.rfind(b" ", lo + 1, lo + most))
        for _ in range(LONGEST - 1):
            back = data.rfind(b" ", lo, back)
        yield data[lo : hi + 1], data[back : hi + 1]
        lo = back
    yield data[lo:], b""


class Runs:
    """Hashes of a chunk's runs of one to four words by where they begin; ``ok[n - 1]``: no piece ends inside the run."""

    def __init__(self, data: bytes, salt: int) -> None:
        raw = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(raw == 0x20)
        self.start, self.end = space[:-1] + 1, space[1:]
        word = ~((self.end - self.start == 1) & (raw[self.start] == 0x0A)) & (self.end > self.start)
        one = span_hashes(raw, self.start, self.end) + np.uint64(salt)
        self.hash, self.ok = [mixed(one)], [word]
        h = one
        for n in range(1, LONGEST):
            h = h[:-1] * _PRIME + one[n:]
            self.hash.append(mixed(h + np.uint64(n)))
            self.ok.append(self.ok[-1][:-1] & word[n:])

    def narrowed(self, bits: np.ndarray, shift: int, sizes: tuple[int, ...]) -> None:
        """Keeps the runs of these sizes whose cells may be frequent, and longer ones of which all such parts may."""
        for n in range(1, LONGEST + 1):
            if n in sizes:
                cell = self.hash[n - 1] >> np.uint64(shift)
                self.ok[n - 1] = self.ok[n - 1] & ((bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            if n > 1:
                shorter = self.ok[n - 2]
                self.ok[n - 1] = self.ok[n - 1] & shorter[:-1] & shorter[1:]


def _salt(lang: str) -> int:
    return int(span_hashes(np.frombuffer(lang.encode() or b"\0", np.uint8), np.array([0]), np.array([max(1, len(lang.encode()))]))[0])


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[tuple[str, bytes, bytes]]:
    """(language, chunk of guarded texts, the words that the next chunk has too) of bounded bytes."""
    held: dict[str, list[bytes]] = {}
    rest: dict[str, bytes] = {}
    size: Counter[str] = Counter()

    def out(lang: str, last: bool) -> Iterator[tuple[str, bytes, bytes]]:
        size.pop(lang)
        data, texts = rest.pop(lang, b""), held.pop(lang, [])
        if texts:
            data = data[:-3] + guarded(texts)
        full = None
        for chunk, twice in chunks(data, most):
            if full:
                yield lang, *full
            full = chunk, twice
        if last or len(full[0]) == len(data) or len(full[0]) >= most:
            yield lang, *full
        else:  # what is over begins the language's next shard
            rest[lang] = full[0]
            size[lang] = len(full[0])

    for piece in pieces(batches, "text"):
        langs, texts = pc.fill_null(piece.column("lang"), "und").to_pylist(), pc.fill_null(piece.column("text"), "").cast(pa.binary())
        for lang, text in zip(langs, texts, strict=True):
            held.setdefault(lang, []).append(text.as_py())
            size[lang] += len(held[lang][-1]) + 3
            if size[lang] >= most:
                yield from out(lang, False)
            elif size.total() >= 3 * most:
                yield from out(size.most_common(1)[0][0], True)
    for lang in list(size):
        yield from out(lang, True)


def _cells(source: DataFrame, bits: int, least: int, sizes: tuple[int, ...], known: tuple | None, most: int) -> np.ndarray:
    """A bit for each cell: whether runs of ``sizes`` words that fall into it are ``least`` together."""
    shift, cap = 64 - bits, min(least, 65535)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["block", "cells", "counts"]

        def out() -> Iterator[pa.RecordBatch]:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            count = np.minimum(count, cap).astype(np.uint16)
            block, first = np.unique(cell >> np.uint32(16), return_index=True)
            ends = np.append(first[1:], len(cell))
            low = cell.astype(np.uint16)
            for lo in range(0, len(block), 4096):
                at = list(zip(first[lo : lo + 4096].tolist(), ends[lo : lo + 4096].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(block[lo : lo + 4096].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in at], pa.binary()), pa.array([count[a:b].tobytes() for a, b in at], pa.binary())], names=names)

        for lang, chunk, _ in shards(batches, most):
            runs = Runs(chunk, _salt(lang))
            if known:
                runs.narrowed(known[0].value, shift, known[1])
            held += [(runs.hash[n - 1][runs.ok[n - 1]] >> np.uint64(shift)).astype(np.uint32) for n in sizes]
            if sum(map(len, held)) >= HOLD:
                yield from out()
        if sum(map(len, held)):
            yield from out()
        release()

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(BLOCK, np.uint32)

        def out() -> Iterator[pa.RecordBatch]:
            if now >= 0 and (total >= cap).any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= cap, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if block != now:
                    yield from out()
                    now, total = block, np.zeros(BLOCK, np.uint32)
                cell = np.frombuffer(cells, np.uint16)
                total[cell] = np.minimum(total[cell] + np.frombuffer(counts, np.uint16), 1 << 20)
        yield from out()

    partial = source.mapInArrow(counted, "block int, cells binary, counts binary")
    blocks = partial.repartition("block").sortWithinPartitions("block").mapInArrow(heavy, "block int, bits binary")
    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.toLocalIterator(prefetchPartitions=True):
        found[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
    return found


class Automaton:
    """Counts phrases, with a space before and behind each, in guarded texts."""

    def __init__(self, phrases: list[str]) -> None:
        import ahocorasick

        self.phrases, self.own = phrases, ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            self.own.add_word(phrase, k)
        if phrases:
            self.own.make_automaton()

    def counts(self, text: str) -> Counter[int]:
        return Counter(map(itemgetter(1), self.own.iter(text))) if self.phrases else Counter()


def shard_counts(chunk: bytes, twice: bytes, runs: Runs) -> tuple[list[str], list[int], int]:
    """(phrases that the runs tell, how often the chunk has each, how many words the chunk has); what ``twice`` has is counted off."""
    found, seen = [], []
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(runs.ok[n - 1])
        if len(at):
            seen.append(at[np.unique(runs.hash[n - 1][at], return_index=True)[1]])
            found += [chunk[a - 1 : b + 1].decode() for a, b in zip(runs.start[seen[-1]].tolist(), runs.end[seen[-1] + n - 1].tolist(), strict=True)]
    del runs  # some ten times the chunk, if the caller keeps none: the automaton takes its place
    own = Automaton(found)
    counts = own.counts(chunk.decode())
    if twice:
        counts.subtract(own.counts(twice.decode()))
    return [own.phrases[k][1:-1] for k in counts], list(counts.values()), _words(chunk) - _words(twice)


def beyond(phrases: list[str], counts: list[int]) -> tuple[list[str], list[int]]:
    """Phrases with their counts less those of phrases longer by a word that begin with them, where any is left.

    Each run that is counted has its first words counted too, so a phrase's count is the sum of what the phrases that begin
    with it, and it itself, have left.
    """
    left = dict(zip(phrases, counts, strict=True))
    for phrase, count in zip(phrases, counts, strict=True):
        first = phrase.rpartition(" ")[0]
        if first in left:
            left[first] -= count
    left = {phrase: count for phrase, count in left.items() if count}
    return list(left), list(left.values())


def summed(batches: Iterator[pa.RecordBatch], most: int = HOLD_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of lang, phrase and f, those of a phrase summed as far as ``most`` bytes hold them."""
    held: list[pa.RecordBatch] = []
    size = 0

    def total() -> pa.Table:
        found = pa.Table.from_batches(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return found.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            held = total().to_batches(max_chunksize=1 << 16)
            size = sum(b.nbytes for b in held)
            if size > most // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from total().to_batches(max_chunksize=1 << 16)


def _by_language(source: DataFrame, size: int) -> DataFrame:
    """The texts dealt so that a task has few languages, at random within them: tasks of a language share most frequent phrases."""
    tasks = max(2 * source.sparkSession.sparkContext.defaultParallelism, size // TASK)
    return source.withColumn("at", F.rand(20240229)).repartitionByRange(tasks, F.coalesce("lang", F.lit("und")), "at").select("lang", "text")


def _words(chunk: bytes) -> int:
    """Words of a guarded text: what stands between spaces, but for line breaks."""
    return max(0, chunk.count(b" ") - 1) - chunk.count(b"\n")


def phrase_counts(docs: DataFrame, min_count: int = 30, text: str = "text", lang: str = "lang", most: int = SHARD, bits: int | None = None) -> DataFrame:
    """``lang``, ``phrase``, ``f``: how often each phrase of one to four words stands in the language's texts, for those of
    ``min_count`` at least; the empty phrase counts all words."""
    spark = docs.sparkSession
    source = docs.select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = min(max((size // 16).bit_length(), LEAST_BITS), MOST_BITS)
    shift = 64 - bits
    short = spark.sparkContext.broadcast(_cells(source, bits, min_count, (1, 2), None, most))
    long = spark.sparkContext.broadcast(_cells(source, bits, min_count, (3, 4), (short, (1, 2)), most))
    kind = T.StructType.fromDDL("lang string, phrase string, f bigint")

    def frequent(name: str, chunk: bytes) -> Runs:
        runs = Runs(chunk, _salt(name))
        runs.narrowed(short.value, shift, (1, 2))
        runs.narrowed(long.value, shift, (3, 4))
        return runs

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, twice in shards(batches, most):
            phrases, counts, words = shard_counts(chunk, twice, frequent(name, chunk))
            phrases, counts = beyond(phrases, counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(counts) + 1), pa.string()), pa.array([*phrases, ""], pa.string()), pa.array([*counts, words], pa.int64())], names=kind.names)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(told(batches))
        release()

    left = _by_language(source, size).mapInArrow(scanned, kind).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    firsts = left.select("lang", F.expr("explode(transform(sequence(1, size(split(phrase, ' ', -1))), n -> substring_index(phrase, ' ', n)))").alias("phrase"), "f")
    counted = firsts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= min_count) | (F.col("phrase") == ""))


def _parts(words: str, least: int, longest: str) -> str:
    """SQL: the runs of ``least`` words or more of an array of words, but for the whole."""
    return f"flatten(transform(sequence({least}, {longest}), n -> transform(sequence(1, size({words}) - n + 1), i -> array_join(slice({words}, i, n), ' '))))"


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80, text: str = "text", lang: str = "lang", most: int = SHARD, bits: int | None = None) -> DataFrame:
    """Each language's best ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two words or more is cut after its first k words into parts that occur ``l`` and ``r`` times; ``score`` is
    the least floor(scale * a / (l + r)), at the smallest k of these. Phrases inside a longer one of ``min_count`` at least
    that has ``percent`` of their count go.
    """
    counts = _store.written(phrase_counts(docs, min_count, text, lang, most, bits), "phrases")
    every = counts.where("phrase <> ''")
    words = every.withColumn("w", F.split("phrase", " ", -1)).where("size(w) > 1").select("lang", "phrase", F.col("f").alias("a"), "w")
    cuts = words.select("lang", "phrase", "a", F.expr("explode(transform(sequence(1, size(w) - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS first, array_join(slice(w, k + 1, size(w) - k), ' ') AS rest))) AS cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    for part, to in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(every.select("lang", F.col("phrase").alias(part), F.col("f").alias(to)), ["lang", part])
    score = F.expr(f"CAST((CAST({scale} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) DIV CAST(l + r AS DECIMAL(20, 0)) AS BIGINT)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = words.where("size(w) > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr(_parts("w", 2, "size(w) - 1"))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
