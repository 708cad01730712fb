"""Surrogate keys and their reserved members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "MISSING"


def member_or_code(key: Column, attribute: Column, codes: dict[int, str]) -> Column:
    """What a dimension shows: the reserved member's code for a negative key; MISSING for no key or no attribute; else the attribute."""
    code = F.coalesce(*[F.when(key == k, v) for k, v in codes.items()], F.lit(MISSING))
    return F.when(key < 0, code).when(key.isNull() | attribute.isNull(), MISSING).otherwise(attribute)


def member_of(c: Column, members: dict[str, str], otherwise: str | None = None) -> Column:
    """What ``members`` says of a value; ``otherwise`` for a null and for a value that it lacks."""
    if not members:
        return F.lit(otherwise).cast("string")
    pairs = F.create_map(*[F.lit(x) for pair in members.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(otherwise).cast("string"))


def entity_key(core_id: Column, cross_id: Column, system: Column, source_id: Column) -> Column:
    """struct(basis, entity_key, provisional): an own id, one by cross-reference, or the source's own as provisional."""
    known = F.coalesce(core_id, cross_id).cast("string")
    basis = F.when(core_id.isNotNull(), "own").when(cross_id.isNotNull(), "cross_reference").otherwise("unresolved")
    return F.struct(basis.alias("basis"), F.when(known.isNotNull(), F.concat(F.lit("ID:"), known)).otherwise(F.concat_ws(":", F.lit("SRC"), system, source_id)).alias("entity_key"), known.isNull().alias("provisional"))


def numbered(df: DataFrame, by: str, name: str, ties: tuple[str, ...] = (), rows: int = 1_000_000) -> DataFrame:
    """Numbers from 1 without a gap in the order of the numeric column ``by``, then ``ties``; nulls come first.

    Cut points at even shares of the rows deal them to buckets of about ``rows``; bucket sizes give each bucket's first
    number, and rows are numbered within their bucket, so no task sorts the table.
    """
    about = df.agg(F.count(F.lit(1)).alias("n")).first()
    buckets = min(10_000, max(1, -(-about["n"] // rows)))
    cuts = sorted(set(df.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)]).alias("c")).first()["c"] or [])) if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    dealt = df.withColumn("__bucket", F.when(F.col(by).isNull(), -1).otherwise(bucket))
    first = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = first.select("__bucket", F.coalesce(F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    order = W.partitionBy("__bucket").orderBy(by, *ties)
    return dealt.join(F.broadcast(first), "__bucket").withColumn(name, F.col("__first") + F.row_number().over(order)).drop("__bucket", "__first")


def reserved_rows(like: DataFrame, rows: list[dict]) -> DataFrame:
    """Rows of reserved members in the columns of ``like``; those not named are null."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in like.schema])
    return like.sparkSession.createDataFrame([tuple(r.get(c) for c in like.columns) for r in rows], schema)
