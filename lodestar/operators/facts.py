"""Facts of events: keys of a person's version and of days, as of the event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.operators import lookups

#: The member of a dimension that stands for a key that is not known.
UNKNOWN = -1


def with_entity(events: DataFrame, versions: DataFrame, person: str, day: str) -> DataFrame:
    """``events`` with entity_sk: the version of ``person`` on the ISO ``day``, or UNKNOWN without a person, a day or a version.

    ``versions`` has columns ``person``, since (timestamp), entity_sk. Rows are neither lost nor repeated.
    """
    timed = events.withColumn("__at", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    found = lookups.as_of(timed, versions, person, "__at", "since", ["entity_sk"], "year")
    return found.drop("__at").withColumn("entity_sk", F.coalesce("entity_sk", F.lit(UNKNOWN)).cast("bigint"))


def with_date_keys(df: DataFrame, days: dict[str, str], series_start: str) -> DataFrame:
    """``df`` with a date key for each {new column: column of ISO days}."""
    return df.withColumns({k: dates.date_key(F.col(c), series_start) for k, c in days.items()})


def with_source(df: DataFrame, sources: DataFrame, system: str) -> DataFrame:
    """``df`` with source_sk of the dimension (source_sk, code); UNKNOWN for a system that it lacks."""
    known = lookups.small(sources.select(F.col("code").alias("__code"), "source_sk"))
    return df.join(known, df[system] == F.col("__code"), "left").drop("__code").withColumn("source_sk", F.coalesce("source_sk", F.lit(UNKNOWN)).cast("bigint"))


def scale_of(day: str, changes: list[tuple[str, str]], last: str) -> Column:
    """The rating scale in force on an ISO day: of (until, scale) in order the first whose end is later, else ``last``. No day has ``last``."""
    return reduce(lambda later, c: F.when(F.col(day) < c[0], c[1]).otherwise(later), reversed(changes), F.lit(last))


def reviews(events: DataFrame, versions: DataFrame, sources: DataFrame, person: str, day: str, system: str, changes: list[tuple[str, str]], last: str, series_start: str) -> DataFrame:
    """Person and review cycle: keys of version, day and source, and the scale of the rating, so that ratings of unlike scales aren't averaged."""
    keyed = with_source(with_entity(events, versions, person, day), sources, system)
    return with_date_keys(keyed, {"date_sk": day}, series_start).withColumns({"scale_type": scale_of(day, changes, last), "reviews": F.lit(1)})


def salary_changes(events: DataFrame, versions: DataFrame, sources: DataFrame, person: str, day: str, system: str, salary: str, series_start: str) -> DataFrame:
    """Person and day of a salary change: keys, and base_salary as a number in the currency it was given in; text that is no number is null."""
    keyed = with_source(with_entity(events, versions, person, day), sources, system)
    return with_date_keys(keyed, {"date_sk": day}, series_start).withColumns({"base_salary": F.col(salary).try_cast("double"), "salary_changes": F.lit(1)})


def applications(events: DataFrame, versions: DataFrame, requisitions: DataFrame, person: str, applied: str, offered: str, hired: str, accepted: Column, series_start: str) -> DataFrame:
    """Candidate and requisition: the person as of the day of hire, keys of three days, flags of offer and acceptance, days to hire.

    ``requisitions`` has (requisition_id, requisition_sk), an id once; an application to none of them has UNKNOWN. Most
    candidates never become a person, and have UNKNOWN too.
    """
    keyed = with_entity(events, versions, person, hired).join(requisitions, "requisition_id", "left")
    keyed = with_date_keys(keyed, {"date_sk_application": applied, "date_sk_offer": offered, "date_sk_hire": hired}, series_start)
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return keyed.withColumns({
        "requisition_sk": F.coalesce("requisition_sk", F.lit(UNKNOWN)).cast("bigint"), "applications": F.lit(1), "offers": F.col(offered).isNotNull().cast("int"),
        "accepts": F.coalesce(accepted, F.lit(False)).cast("int"), "days_to_hire": F.datediff(day(hired), day(applied)),
    })
