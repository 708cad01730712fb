"""Profiles of columns, all of a dataset in one aggregate, and what they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed: the value formats that a profile tells.
PATTERNS = {
    "iso_date": r"^\d{4}-\d{2}-\d{2}$", "slash_date": r"^\d{1,2}/\d{1,2}/\d{4}$", "short_year_date": r"^\d{1,2}/\d{1,2}/\d{2}$", "compact_date": r"^(19|20)\d{6}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", "comma_decimal": r"^-?\d{1,3}(\.\d{3})*,\d+$|^-?\d+,\d+$",
    "point_decimal": r"^-?\d+\.\d+$", "mojibake": "[ÃÂ][\u0080-¿]", "edge_space": r"^\s|\s$", "upper": r"^[^a-z]*[A-Z][^a-z]*$",
}


def profiled(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, nulls, null_rate, distinct_values, min_length, max_length and the share of each pattern.

    All but the distinct values are one aggregate of a row; those are counted from one table of (column, value), which
    shrinks before it is shuffled, so no row is expanded once a column with all its values.
    """
    aggregates = []
    for c in columns:
        s = F.col(c).cast("string")
        shares = [F.round(F.avg(s.rlike(p).cast("double")), 6).alias(k) for k, p in PATTERNS.items()]
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(s)).alias("nulls"), F.round(1 - F.try_divide(F.count(s), F.count(F.lit(1))), 6).alias("null_rate"),
                F.min(F.char_length(s)).cast("bigint").alias("min_length"), F.max(F.char_length(s)).cast("bigint").alias("max_length"), *shares,
            )
        )
    told = df.agg(F.array(*aggregates).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    distinct = counted_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return told.join(distinct, "column", "left").select("column", "rows", "nulls", "null_rate", F.coalesce("distinct_values", F.lit(0)).cast("bigint").alias("distinct_values"), "min_length", "max_length", *PATTERNS)


def counted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the values that are not null; one pass for all columns."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    return pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each column, ties by value; one pass for all columns."""
    ranked = counted_values(df, columns).withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= k)


def findings(profile: DataFrame) -> DataFrame:
    """(column, finding): what a profile points at."""
    rules = [
        ("MANY_NULLS", F.col("null_rate") > 0.2), ("MOJIBAKE", F.col("mojibake") > 0.01), ("DATES_NOT_ISO", F.col("slash_date") + F.col("short_year_date") + F.col("compact_date") > 0.5), ("COMMA_DECIMALS", F.col("comma_decimal") > 0.5),
        ("EDGE_SPACES", F.col("edge_space") > 0.01), ("MIXED_CASE", (F.col("upper") > 0.05) & (F.col("upper") < 0.95)), ("SMALL_DOMAIN", F.col("distinct_values").between(2, 30)),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return profile.select("column", F.explode(hits).alias("finding"))
