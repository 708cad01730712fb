"""Value mapping with validity windows, its exceptions, and what is proposed for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import numbered
from lodestar.functions.text import normal_key
from lodestar.operators.lookups import interval_lookup

UNMAPPED = "UNMAPPED"


def approved(table: DataFrame) -> DataFrame:
    """Approved entries in the shape interval_lookup() takes; needs source_value, standard_value, mapping_id, mapping_status, valid_from, valid_to, ordinal."""
    keyed = table.where(F.col("mapping_status") == "APPROVED").withColumn("key", normal_key(F.col("source_value")))
    return keyed.select("key", "standard_value", "mapping_id", F.coalesce("valid_from", F.lit("")).alias("valid_from"), F.coalesce("valid_to", F.lit("")).alias("valid_to"), "ordinal")


def mapped(df: DataFrame, table: DataFrame, column: str, date: str, name: str) -> DataFrame:
    """``df`` with std_<name> and its mapping_id: null stays null, a value without an entry is UNMAPPED, nothing is guessed."""
    keyed = df.withColumn("__value_key", normal_key(F.col(column)))
    out = interval_lookup(keyed, approved(table), "__value_key", date)
    std = F.when(F.col(column).isNotNull(), F.coalesce("standard_value", F.lit(UNMAPPED)))
    return out.withColumn(f"std_{name}", std).withColumn(f"std_{name}__mapping_id", F.col("mapping_id")).drop("__value_key", "standard_value", "mapping_id")


def exceptions(df: DataFrame, column: str, name: str, seen: str) -> DataFrame:
    """(source_value, occurrences, first_seen, last_seen) of each value that has no entry."""
    return df.where(F.col(f"std_{name}") == UNMAPPED).groupBy(F.col(column).alias("source_value")).agg(F.count(F.lit(1)).alias("occurrences"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def merged_queue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue after a run: open entries count anew, decided ones keep their decision, new values are OPEN."""
    old = queue.select("source_value", "status", F.col("first_seen").alias("first_before"))
    both = old.join(found, "source_value", "full")
    decided = F.col("status").isin("APPROVED", "REJECTED", "UNDER_REVIEW")
    kept = both.where(F.col("occurrences").isNotNull() | decided)
    return kept.select("source_value", F.coalesce("status", F.lit("OPEN")).alias("status"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.least("first_before", "first_seen").alias("first_seen"), "last_seen")


def in_order(queue: DataFrame, first: str, *ties: str) -> DataFrame:
    """The queue with ``place``: those with most of ``first`` (occurrences, confidence) come first, then by ``ties``."""
    return numbered(queue.withColumn("__less", -F.col(first)), "__less", "place", ties).drop("__less")


# Fixed values of the ladder: scores 0.80 and 0.55, gap 0.12.


def proposal_class(score: Column, second: Column, same_text: Column, own_scale: Column, other_language: Column) -> Column:
    """What to do with an unmapped value, by its best two candidates; the first rule that holds."""
    gap = F.round(score - second, 3)
    return (
        F.when(own_scale, "BUSINESS_DECISION").when(same_text, "SPELLING_VARIANT").when((score >= 0.80) & (gap >= 0.12), "KNOWN_ALIAS").when((score >= 0.55) & (gap < 0.12) & ~other_language, "BUSINESS_DECISION")
        .when(other_language, "TRANSLATION_PENDING").when(score >= 0.55, "LIKELY_CANDIDATE").otherwise("WEAK_CANDIDATE")
    )


def awaiting_decision(scales: dict[str, list[str]], own: str) -> list[str]:
    """Values of scales that systems other than ``own`` declare: theirs to be decided on by people, never inferred."""
    foreign = {v for system, values in scales.items() if system != own for v in values}
    return sorted(foreign - set(scales.get(own, ())))
