"""Sharding in Hilbert-curve order, with DataFrame functions only.

Three metadata dimensions are quantised to 32 steps each, in their own order, so that steps side by side are values side by
side: two labels by the share of rows with a smaller label, so that a label of a 32nd of the rows or more has a step of its
own, and the size by two steps for each doubling, spread over the sizes that occur. Rows are sorted by the cell's index on
a three-dimensional Hilbert curve, then by a hash of the id, id, checksum and size, and the order is cut into runs of equal
rows, so that each shard covers few neighbouring values of every dimension and readers prune files by any of them.

The place of a row is found without one global sort: counts of at most 32,768 cells give each cell's first place; a cell
with many rows is cut by the id's hash into buckets of about ``bucket_rows``, whose counts give each bucket's first
place; within a bucket rows are numbered. A label that a third of the rows have is thus spread over many tasks, and no
text is shuffled. Labels are counted first; their shares come from sums over ranges of the labels, not from one sort.

Null labels count as empty ones, a null text as no bytes, a null id comes first. Equal rows get places side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import bounded, written

BITS = 5
#: Fixed values of the curve in three dimensions, by octant: inverse of the Gray code, entry corner, direction.
GRAY_INVERSE = (0, 1, 3, 2, 7, 6, 4, 5)
ENTRY = (0, 0, 0, 3, 3, 6, 6, 5)
DIRECTION = (0, 1, 1, 2, 2, 1, 1, 0)


def _pick(values: tuple[int, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _turned(x: Column, by: Column) -> Column:
    """The three bits of x, turned right by 0, 1 or 2."""
    return F.when(by == 0, x).when(by == 1, F.shiftright(x, 1).bitwiseOR(F.shiftleft(x.bitwiseAND(1), 2))).otherwise(F.shiftright(x, 2).bitwiseOR(F.shiftleft(x.bitwiseAND(3), 1)))


def curve_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve through a cube of 2**bits cells a side."""

    def step(state: Column, bit: Column) -> Column:
        octant = F.call_function("shiftright", x, bit).bitwiseAND(1) + F.call_function("shiftright", y, bit).bitwiseAND(1) * 2 + F.call_function("shiftright", z, bit).bitwiseAND(1) * 4
        by = (state["d"] + 1) % 3
        digit = _pick(GRAY_INVERSE, _turned(octant.bitwiseXOR(state["e"]), by))
        entry = state["e"].bitwiseXOR(_turned(_pick(ENTRY, digit), (3 - by) % 3))
        return F.struct(entry.alias("e"), ((state["d"] + _pick(DIRECTION, digit) + 1) % 3).alias("d"), (state["h"] * 8 + digit).alias("h"))

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def _label_steps(rows: DataFrame, label: str, step: str) -> DataFrame:
    """(label, step): the share of rows with a smaller label, in 32nds."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(label).withColumn("range", F.spark_partition_id())
    counts = written(counts, "label-counts")
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    smaller = W.partitionBy("range").orderBy(label).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0))).join(F.broadcast(ranges), "range")
    return written(placed.select(label, F.expr(f"(first + before) * {1 << BITS} div total").cast("int").alias(step)), "label-steps")


def _size_step(size: Column) -> Column:
    """Two steps for each doubling, from 16 on."""
    bits = F.bin(size)
    return F.least(F.greatest(F.length(bits) * 2 + F.substring(bits, 2, 1).cast("int") - 10, F.lit(0)), F.lit(31))


def sharded(df: DataFrame, shards: int = 40, doc: str = "doc_id", text: str = "text", labels: tuple[str, str] = ("lang", "source"), bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the cell's curve_index of each row."""
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    slim = df.select(
        df[doc].alias("doc_id"), (F.octet_length(body).cast("bigint") + 16).alias("size"), F.crc32(body).alias("text_crc32"),
        *[F.coalesce(df[c].cast("string"), F.lit("")).alias(k) for c, k in zip(labels, ("a", "b"), strict=True)],
        F.conv(F.substring(F.md5(F.coalesce(df[doc].cast("string"), F.lit(""))), 1, 4), 16, 10).cast("bigint").alias("h"),
    )
    slim = written(slim.withColumn("step", _size_step(F.col("size"))), "shard-keys")
    seen = slim.agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = seen["lo"] or 0, seen["hi"] or 0
    rows = slim
    for label, axis in (("a", "x"), ("b", "y")):
        rows = rows.join(bounded(_label_steps(slim, label, axis), F.octet_length(label) + 32), label)
    rows = written(rows.select("doc_id", "size", "text_crc32", "h", "x", "y", F.expr(f"(step - {lo}) * {1 << BITS} div {hi - lo + 1}").cast("int").alias("z")), "shard-cells")
    cells = rows.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")).withColumn("curve_index", curve_index(F.col("x"), F.col("y"), F.col("z")))
    along = W.orderBy("curve_index").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("x", "y", "z", "curve_index", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_first"), F.ceil(F.col("n") / bucket_rows).alias("cuts"))
    rows = rows.join(F.broadcast(cells), ["x", "y", "z"]).withColumn("bucket", F.floor(F.col("h") * F.col("cuts") / 65536))
    within = W.partitionBy("curve_index").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy("curve_index", "bucket").agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.select("curve_index", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("bucket_first"))
    order = W.partitionBy("curve_index", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    placed = rows.join(buckets, ["curve_index", "bucket"]).withColumn("place", F.col("cell_first") + F.col("bucket_first") + F.row_number().over(order) - 1)
    total = max(seen["n"], 1)
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div {total}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")
