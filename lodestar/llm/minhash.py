"""MinHash near-dedup: universal hash minima, bands, verification, and components by large-star and small-star.

1. A text's set is its distinct shingles of five lower-cased words (a shorter text: its words as one). Texts of equal
   sets make one class from here on, known by a 128-bit fingerprint and its smallest doc_id, so exact copies cost no pairs.
2. Minima of (a * x + b) mod 2**64 are a class's signature; bands of five are its buckets, as many as leave two classes
   of the least similarity without a common bucket with a chance of at most 5e-7: 25 bands at 0.85, 37 at 0.80.
3. In each bucket, all are paired with one centre, the class that meets most others over all bands. A pair goes on if
   its signatures agree in enough places (4.7 standard deviations below the least similarity, 0.70 at 0.85) and is confirmed on the full sets.
4. Components of the confirmed links. Where a bucket still holds several components, members of different ones are
   compared in blocks of bounded size, by signature and then on full sets. A block gives links, never candidate pairs,
   and a bucket whose members are all joined costs nothing, so no link is lost and no group becomes all its pairs.
5. Components of all confirmed links.

Only ids, signatures of colliding classes and the texts of pairs are shuffled (texts of others too where pairs name more
ids than may be broadcast). Nothing is collected to the driver but
two numbers in each round. Null and empty texts have an empty set and are linked with nothing, also not with each other.
Rows without a doc_id are linked with nothing: their component_id is null and they are kept. Rows that share a doc_id
are judged by their own texts: a class goes by its smallest doc_id while no other class has the same, else by a hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import annotated, bytes_of, pieces
from ._store import on_disk, only, written
from ._words import mixed, shingle_hashes, words_of

#: Places of a band, and the chance that two classes of the least similarity share no bucket.
ROWS, MISSED = 5, 5e-7
#: Members of a bucket compared at once, and of a centre's group confirmed in one run.
BLOCK, GROUP = 1000, 400


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text, and each text's first."""
    doc, h = shingle_hashes(words_of(*bytes_of(texts), lower=True), shingle)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def bands_for(percent: int) -> int:
    """Bands that leave two classes of this similarity without a common bucket with a chance of at most MISSED."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


@lru_cache
def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(85))
    a = rng.integers(0, 2**64, hashes, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, hashes, dtype=np.uint64)


def minima(h: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """Signatures, a row for each text that has shingles."""
    starts = first[:-1][first[1:] > first[:-1]]
    out = np.empty((len(starts), hashes), np.uint32)
    if len(starts):
        for k, (a, b) in enumerate(zip(*_coefficients(hashes), strict=True)):
            out[:, k] = np.minimum.reduceat(h * a + b, starts) >> np.uint64(32)
    return out


def signatures(df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns ``keep``, n_shingles, the set's fingerprint and its signature (null for an empty set)."""
    hashes = ROWS * bands_for(percent)

    def make() -> Callable[[pa.Array], dict]:
        def run(texts: pa.Array) -> dict:
            h, first = _sets(texts, shingle)
            n = np.diff(first)
            own = np.flatnonzero(n)
            prints = _prints(h, first)
            signed = minima(h, first, hashes)
            columns: dict = {"n_shingles": n, "fingerprint": [None] * len(n), "signature": [None] * len(n)}
            for k, i in enumerate(own.tolist()):
                columns["fingerprint"][i] = prints[k].tobytes()
                columns["signature"][i] = signed[k].tobytes()
            return columns

        return run

    return annotated(df.withColumnRenamed(doc, "doc_id") if doc != "doc_id" else df, text, ["doc_id", *keep], make, "n_shingles bigint, fingerprint binary, signature binary", most=1 << 18)


def classes_of(usable: DataFrame, rows: int) -> DataFrame:
    """A row for each fingerprint: rep, its own number; doc, its smallest doc_id; n, signature.

    The number is the doc_id, but a hash of the fingerprint where several classes have one smallest doc_id.
    """
    classes = usable.groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("rep", F.col("doc")), "classes", rows=rows)
    same = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc")
    if same.isEmpty():
        return classes
    clash = written(same, "clashes")
    apart = only(classes, "doc", clash, "doc").withColumn("rep", F.xxhash64("fingerprint"))
    return written(only(classes, "doc", clash, "doc", "left_anti").unionByName(apart), "classes", rows=rows)


def _agreeing(pairs: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (x, c) whose signatures agree in ``least`` places and whose sizes allow the similarity."""
    hashes = ROWS * bands_for(percent)
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}"))
    both = pairs.join(side("x"), "x").join(side("c"), "c")
    both = both.where(F.least("n_x", "n_c") * 100 >= F.greatest("n_x", "n_c") * percent).select("x", "c", "s_x", "s_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint32).reshape(-1, hashes) for k in (2, 3))
                good = pa.array((a == b).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["x", "c"])

    return both.mapInArrow(run, "x bigint, c bigint")


def _prints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 24-byte fingerprints of the sets that are not empty."""
    own = np.flatnonzero(np.diff(first))
    sums = [np.add.reduceat(x, first[:-1][own]) if len(own) else x for x in (h, mixed(h ^ np.uint64(0x5851F42D4C957F2D)))]
    return np.stack([*sums, np.diff(first)[own].astype(np.uint64)], 1)


def _confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, shingle: int, held: list[DataFrame]) -> DataFrame:
    """The pairs (x, c) whose full sets have the similarity. A centre's partners are dealt to runs of about GROUP.
    What is kept on disk meanwhile goes to ``held``."""
    runs = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("runs"))
    dealt = pairs.join(runs, "c").select("c", F.pmod(F.xxhash64("x"), "runs").cast("int").alias("run"), F.col("x").alias("id"), F.lit(1).alias("turn"))
    centres = runs.select("c", F.explode(F.sequence(F.lit(0), F.col("runs").cast("int") - 1)).alias("run"), F.col("c").alias("id"), F.lit(0).alias("turn"))
    named = classes.select(F.col("rep").alias("id"), "doc", "fingerprint")
    wanted = on_disk(dealt.unionByName(centres).join(named, "id"))
    held.append(wanted)
    texts = only(texts, "doc_id", wanted, "doc")
    rows = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"] == wanted["doc"]).select("c", "run", "id", "turn", "text", "fingerprint")
    rows = rows.repartition("c", "run").sortWithinPartitions("c", "run", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for piece in pieces(batches, "text", 1 << 19):
            h, first = _sets(piece.column("text"), shingle)
            prints = iter(_prints(h, first))
            found = []
            for k, (c, i, turn, of) in enumerate(zip(*(piece.column(n).to_pylist() for n in ("c", "id", "turn", "fingerprint")), strict=True)):
                own = h[first[k] : first[k + 1]]
                if not len(own) or next(prints).tobytes() != of:
                    continue  # another text of the same id
                if turn == 0:
                    now, centre = c, own.copy()
                    continue
                assert now == c
                shared = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * shared >= percent * (len(centre) + len(own) - shared):
                    found.append((i, c))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["x", "c"])

    return rows.mapInArrow(run, "x bigint, c bigint")


def components(links: DataFrame, most: int | None = None, u: str = "x", v: str = "c") -> DataFrame:
    """(node, component) of each node of the links but a component's smallest, of which there are at most ``most``: alternating large-star and
    small-star until nothing changes. Neither step makes more edges than it is given."""
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()
    edges = written(edges, "edges", rows=most)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small, "edges", rows=state[0])


def _block_pairs(block: list[dict], least: int, percent: int) -> Iterator[tuple[int, int]]:
    """Rows of a block whose classes are in different components, agree by signature and meet in no earlier band."""
    comp, n, own = (np.array([r[k] for r in block]) for k in ("component", "n", "own"))
    if (comp == comp[0]).all():
        return
    sig = np.frombuffer(b"".join(r["signature"] for r in block), np.uint32).reshape(len(block), -1)
    short = sig.astype(np.uint8)
    names, counts = np.unique(comp, return_counts=True)
    largest, band, apart = names[counts.argmax()], block[0]["band"], block[0]["i"] != block[0]["j"]
    for a in np.flatnonzero(comp != largest):
        other = (comp != comp[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        other[: a + 1] &= comp[: a + 1] == largest
        if apart:
            other &= own != own[a]
        b = np.flatnonzero(other)
        b = b[(short[b] == short[a]).sum(1) >= least]
        same = sig[b] == sig[a]
        b = b[(same.sum(1) >= least) & ~same[:, : ROWS * band].reshape(len(b), band, ROWS).all(2).any(1)]
        for k in b[np.argsort(-(sig[b] == sig[a]).sum(1), kind="stable")].tolist():
            yield int(a), k


def _blocks(batches: Iterator[pa.RecordBatch], shingle: int = 0) -> Iterator[list[dict]]:
    """Runs of rows of one block; with ``shingle``, each with the set of its text."""
    block: list[dict] = []
    for piece in pieces(batches, "text", 1 << 19) if shingle else batches:
        if shingle:
            h, first = _sets(piece.column("text"), shingle)
            prints = iter(_prints(h, first))
        for k, row in enumerate(piece.drop_columns(["text"]).to_pylist() if shingle else piece.to_pylist()):
            if shingle:
                row["set"] = h[first[k] : first[k + 1]].copy()
                if not len(row["set"]) or next(prints).tobytes() != row["fingerprint"]:
                    continue  # another text of the same id
            if block and any(block[-1][c] != row[c] for c in ("h", "i", "j")):
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, least: int, percent: int, shingle: int, held: list[DataFrame]) -> DataFrame:
    """Links between members of one bucket and different components; pairs with the centre were tried before.

    Signatures say which members have a partner at all; those are compared on full sets, block by block. A block gives
    at most one link for each of its members, as pairs that its links join already are passed over.
    """
    left = members.where("rep != centre")
    several = left.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi")
    rows = left.join(several.select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("k")), "h")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component")
    rows = rows.join(classes, "rep").select("h", "band", "i", "j", "own", "rep", "doc", "component", "n", "fingerprint", "signature")
    rows = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "rep")
    fields = rows.schema

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = batch.schema
            break
        else:
            return
        for block in _blocks(itertools.chain([batch], batches)):
            good = sorted({k for pair in _block_pairs(block, least, percent) for k in pair})
            if good:
                yield pa.RecordBatch.from_pylist([block[k] for k in good], schema=kind)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, shingle):
            root = {r["component"]: r["component"] for r in block}

            def find(x: int) -> int:
                while root[x] != x:  # noqa: B023
                    root[x] = x = root[root[x]]  # noqa: B023
                return x

            found = []
            for a, b in _block_pairs(block, least, percent):
                x, y = find(block[a]["component"]), find(block[b]["component"])
                if x == y:
                    continue
                one, two = block[a]["set"], block[b]["set"]
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    root[x] = y
                    found.append((block[a]["rep"], block[b]["rep"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["x", "c"])

    rows = on_disk(rows.mapInArrow(partnered, fields))
    held.append(rows)
    texts = only(texts, "doc_id", rows, "doc")
    rows = texts.join(rows.hint("shuffle_hash"), texts["doc_id"] == rows["doc"]).drop("doc_id").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "rep")
    return rows.mapInArrow(linked, "x bigint, c bigint").distinct()


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns ``keep``, n_shingles, component_id, kept of each row; a link needs 100 * intersection >= percent * union.

    ``kept`` is whether doc_id = component_id and the row is of its component's first class, which only matters where
    rows of different texts share a doc_id.
    """
    n_bands = bands_for(percent)
    hashes = ROWS * n_bands
    least = int((percent / 100 - 4.7 * (percent / 100 * (1 - percent / 100) / hashes) ** 0.5) * hashes)
    docs = df.select(df[doc].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"), *[df[c] for c in keep])
    signed = on_disk(signatures(docs, shingle=shingle, percent=percent, keep=keep))
    usable = signed.where("doc_id IS NOT NULL AND signature IS NOT NULL")
    total = signed.count()
    classes = classes_of(usable, total)
    bands = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(signature, {4 * ROWS * b + 1}, {4 * ROWS})")) for b in range(n_bands)])
    banded = classes.select("rep", F.posexplode(bands).alias("band", "h"))
    sizes = banded.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = on_disk(banded.join(sizes, "h"))
    degree = met.groupBy("rep").agg(F.sum("m").alias("degree"))
    centres = met.join(degree, "rep").groupBy("h").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("centre"))
    members = on_disk(met.join(centres, "h").select("h", "band", "rep", "centre"))
    many = members.count()
    pairs = members.where("rep != centre").select(F.col("rep").alias("x"), F.col("centre").alias("c")).distinct()
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    agreed = written(_agreeing(pairs, classes, least, percent), "agreed", rows=many)
    held = [met, members]
    links = _confirmed(agreed, texts, classes, percent, shingle, held)
    joined = components(links, many)
    placed = members.join(joined, members["rep"] == joined["node"], "left").select("h", "band", "rep", "centre", F.coalesce("component", "rep").alias("component"))
    more = written(_across(placed, classes, texts, least, percent, shingle, held), "across", rows=many)
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("x"), F.col("component").alias("c")).unionByName(more), 2 * many)
    nodes = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    about = nodes.join(classes.select("rep", "doc"), F.col("node") == F.col("rep"))
    lowest = F.min(F.struct("doc", "rep"))
    whole = about.groupBy("component").agg(lowest.alias("low"))
    about = about.join(whole, "component").select("rep", F.col("low.doc").alias("component_id"), (F.col("low.rep") == F.col("rep")).alias("head"))
    named = classes.select("fingerprint", "rep", "doc").join(about, "rep", "left").select("fingerprint", F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("head", F.lit(True)).alias("head"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = signed.join(named, "fingerprint", "left").select("doc_id", *keep, "n_shingles", own.alias("component_id"), F.coalesce((F.col("doc_id") == own) & F.coalesce("head", F.lit(True)), F.lit(True)).alias("kept"))
    out = written(out, "near-duplicates")
    for part in [signed, *held]:
        part.unpersist()
    return out
