"""Conservative identity resolution: by exact id, else by name and date, else by name; only an exact id resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed values of confidence: exact id 1.0, name and date 0.85, name 0.6, none 0.0.


def resolved(people: DataFrame, anchor: DataFrame, system: str) -> DataFrame:
    """(source_system, source_id, entity_id, method, confidence, match_status) of each row of ``people``.

    ``people`` has source_id, id, name, date; ``anchor`` has entity_id, name, date. One candidate is for review, several
    are ambiguous, and neither is ever promoted. Candidates are counted by key before the join, so rows never multiply.
    """
    ids = anchor.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("__exact")).distinct()
    both = anchor.where("name IS NOT NULL AND date IS NOT NULL").groupBy(F.col("name").alias("__n1"), F.col("date").alias("__d1")).agg(F.count_distinct("entity_id").alias("__both"), F.min("entity_id").alias("__both_id"))
    names = anchor.where("name IS NOT NULL").groupBy(F.col("name").alias("__n2")).agg(F.count_distinct("entity_id").alias("__names"), F.min("entity_id").alias("__names_id"))
    rows = people.join(ids, people["id"] == ids["__exact"], "left")
    rows = rows.join(both, (F.col("name") == F.col("__n1")) & (F.col("date") == F.col("__d1")), "left").join(names, F.col("name") == F.col("__n2"), "left")
    exact, one, many = F.col("__exact").isNotNull(), F.col("__both") == 1, F.col("__both") > 1
    name_one, name_many = F.col("__names") == 1, F.col("__names") > 1
    pick = lambda *v: F.when(exact, v[0]).when(one, v[1]).when(many, v[2]).when(name_one, v[3]).when(name_many, v[4]).otherwise(v[5])
    none = F.lit(None).cast("bigint")
    return rows.select(
        F.lit(system).alias("source_system"), F.col("source_id"),
        pick(F.col("__exact"), F.col("__both_id"), none, F.col("__names_id"), none, none).alias("entity_id"),
        pick(*map(F.lit, ("exact_id", "name_date", "name_date", "name", "name", "none"))).alias("method"),
        pick(*map(F.lit, (1.0, 0.85, 0.85, 0.6, 0.6, 0.0))).alias("confidence"),
        pick(*map(F.lit, ("RESOLVED", "MANUAL_REVIEW", "AMBIGUOUS", "MANUAL_REVIEW", "AMBIGUOUS", "UNRESOLVED"))).alias("match_status"),
    )


def suspected_duplicates(anchor: DataFrame) -> DataFrame:
    """(name, date, ids): anchors that share both."""
    return anchor.where("name IS NOT NULL AND date IS NOT NULL").groupBy("name", "date").agg(F.count_distinct("entity_id").alias("ids")).where("ids > 1")
