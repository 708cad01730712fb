"""Joins against dictionaries and dimensions: by validity, as of a time, with reserved members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a dictionary or dimension is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``most_bytes`` of text, both counted first."""
    row = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    about = df.limit(most + 1).select(row.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if about["n"] <= most and (about["b"] or 0) <= most_bytes else df


def interval_lookup(df: DataFrame, table: DataFrame, key: str, date: str, value: str = "standard_value", ident: str = "mapping_id") -> DataFrame:
    """``df`` with the table's value and id: the first entry, by ``ordinal``, of the row's key that is valid at its date.

    The table has columns key, valid_from, valid_to (ISO text, empty: open, both ends count), ordinal. Without a date only
    entries without an end are valid. A row without an entry gets nulls; rows are neither lost nor repeated.
    Entries of a key are gathered to one array, so each row meets its key once, however many entries there are.
    """
    entry = F.struct("ordinal", "valid_from", "valid_to", F.col(value).alias("v"), F.col(ident).alias("i"))
    entries = small(table.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(entry)).alias("__entries")))
    d = F.col(date)

    def valid(e: Column) -> Column:
        return F.when(d.isNull(), e["valid_to"] == "").otherwise(((e["valid_from"] == "") | (d >= e["valid_from"])) & ((e["valid_to"] == "") | (d <= e["valid_to"])))

    joined = df.join(entries, df[key] == F.col("__key"), "left").withColumn("__hit", F.get(F.filter("__entries", valid), F.lit(0)))
    return joined.withColumn(value, F.col("__hit.v")).withColumn(ident, F.col("__hit.i")).drop("__key", "__entries", "__hit")


def as_of(df: DataFrame, versions: DataFrame, key: str, time: str, since: str, take: list[str], period: str = "month") -> DataFrame:
    """``df`` with columns ``take`` of the latest version of its key that began at or before its time; else nulls.

    Versions and rows meet in buckets of key and ``period``, so a key that a third of the rows have is dealt over time.
    What a bucket starts with is the last version of the key's earlier buckets, from a table of one row a bucket.
    Of versions that begin together the largest ``take`` counts. Null keys and times match nothing; such rows are dealt by
    their other columns, so that they don't land in one task.
    """
    ready = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    version = F.struct(F.col(since).alias("since"), *take)
    rows = df.withColumn("__bucket", F.date_trunc(period, time))
    plain = [df[f.name] for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    place = F.when(F.col(key).isNotNull() & F.col("__bucket").isNotNull(), F.xxhash64(F.col(key), "__bucket")).otherwise(F.xxhash64(*plain))
    rows = rows.withColumn("__place", place)
    starts = ready.select(F.col(key).alias("__key"), F.date_trunc(period, since).alias("__bucket"), version.alias("__version"))
    last = starts.groupBy("__key", "__bucket").agg(F.max("__version").alias("__last"))
    asked = rows.where(F.col(key).isNotNull() & F.col("__bucket").isNotNull()).select(F.col(key).alias("__key"), "__bucket").distinct()
    along = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = asked.join(last, ["__key", "__bucket"], "full").withColumn("__before", F.last("__last", ignorenulls=True).over(along)).select("__key", "__bucket", "__before")
    within = starts.groupBy("__key", "__bucket").agg(F.array_sort(F.collect_list("__version")).alias("__versions"))
    state = carried.join(within, ["__key", "__bucket"], "left").where(F.col("__before").isNotNull() | F.col("__versions").isNotNull())
    state = state.withColumn("__of", F.xxhash64("__key", "__bucket"))
    joined = rows.join(state, (rows["__place"] == state["__of"]) & (rows[key] == state["__key"]) & (rows["__bucket"] == state["__bucket"]), "left").drop(state["__bucket"])
    hit = F.coalesce(F.try_element_at(F.filter("__versions", lambda v: v["since"] <= F.col(time)), F.lit(-1)), F.col("__before"))
    joined = joined.withColumn("__hit", hit)
    return joined.select(*df.columns, *[F.col(f"__hit.{c}").alias(c) for c in take])


def key_or(df: DataFrame, dimension: DataFrame, on: list[tuple[str, str]], key: str, name: str, otherwise: int) -> DataFrame:
    """``df`` with the dimension's key under ``name``; ``otherwise`` where nothing matches. A null never matches."""
    side = dimension.select(*[F.col(d).alias(f"__{k}") for k, (_, d) in enumerate(on)], F.col(key).cast("bigint").alias("__sk"))
    side = small(side.groupBy(*[f"__{k}" for k in range(len(on))]).agg(F.min("__sk").alias("__sk")))
    match = [df[c] == side[f"__{k}"] for k, (c, _) in enumerate(on)]
    return df.join(side, match, "left").select(*[df[c] for c in df.columns], F.coalesce("__sk", F.lit(otherwise)).alias(name))


def level_key(df: DataFrame, dimension: DataFrame, mapped: str, raw: str, undecided: list[str], name: str, code: str = "code", key: str = "sk", pending: int = -2, unknown: int = -1) -> DataFrame:
    """A key by its code; a miss is ``pending`` if the raw value awaits a decision, else ``unknown``."""
    joined = key_or(df, dimension, [(mapped, code)], key, name, unknown)
    return joined.withColumn(name, F.when((F.col(name) == unknown) & F.coalesce(F.col(raw).isin(undecided), F.lit(False)), pending).otherwise(F.col(name)))
