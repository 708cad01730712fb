"""Slowly changing dimensions from observations, calendars, and checks of histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import dates

OPEN_END = "9999-12-31"


def islands(df: DataFrame, entity: str, order: list[str], tracked: list[str]) -> DataFrame:
    """(entity, version, effective_from, last_seen, observations, *tracked): runs of equal tracked values, nulls equal.

    ``order[0]`` is the observation's date. All windows of one entity are one sort.
    """
    by = W.partitionBy(entity).orderBy(*order)
    signature = F.struct(*[F.col(c) for c in tracked])
    changed = F.lag(F.lit(1)).over(by).isNull() | ~F.lag(signature).over(by).eqNullSafe(signature)
    marked = df.select(entity, *order, *tracked, changed.cast("int").alias("__new"))
    marked = marked.withColumn("version", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    last = F.struct(*order)
    return marked.groupBy(entity, "version").agg(F.min(order[0]).alias("effective_from"), F.max(order[0]).alias("last_seen"), F.count(F.lit(1)).alias("observations"), *[F.max_by(c, last).alias(c) for c in tracked])


def closed(versions: DataFrame, entity: str) -> DataFrame:
    """Versions with effective_to, the day before the next one's start or OPEN_END, and is_current."""
    following = F.lead("effective_from").over(W.partitionBy(entity).orderBy("effective_from", "version"))
    end = F.when(following.isNull(), OPEN_END).otherwise(dates.iso(F.date_sub(following, 1)))
    return versions.withColumn("effective_to", end).withColumn("is_current", F.col("effective_to") == OPEN_END)


def with_reasons(versions: DataFrame, movements: DataFrame, entity: str) -> DataFrame:
    """change_reason: ENTRY for an entity's first version, the month's movement (of several the least), else OBSERVED."""
    monthly = movements.groupBy(F.col(entity).alias("__e"), dates.month_of("movement_date").alias("__m")).agg(F.min("movement_type").alias("__t"))
    joined = versions.join(monthly, (versions[entity] == F.col("__e")) & (dates.month_of("effective_from") == F.col("__m")), "left")
    reason = F.when(F.col("version") == 1, "ENTRY").otherwise(F.coalesce("__t", F.lit("OBSERVED")))
    return joined.withColumn("change_reason", reason).drop("__e", "__m", "__t")


def history_faults(versions: DataFrame, entity: str) -> DataFrame:
    """(entity, fault) where versions overlap, leave a gap, or several or none are current.

    Of versions that begin together those that end first come first, so one that was replaced on its first day is no fault.
    """
    following = F.lead("effective_from").over(W.partitionBy(entity).orderBy("effective_from", "effective_to"))
    fault = F.when(following <= F.col("effective_to"), "OVERLAP").when(F.datediff(following, F.col("effective_to")) > 1, "GAP")
    found = versions.select(entity, fault.alias("fault")).where("fault IS NOT NULL")
    current = versions.groupBy(entity).agg(F.count_if("is_current").alias("n")).where("n <> 1").select(entity, F.lit("NOT_ONE_CURRENT").alias("fault"))
    return found.unionByName(current).distinct()


def calendar(spark, start: str, end: str) -> DataFrame:
    """A row a day, from configuration and never from data."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d")
    return days.select(*_day(F.col("d")))


def _day(d: Column) -> list[Column]:
    return [
        dates.iso(d).alias("date_iso"), F.date_format(d, "yyyyMMdd").cast("bigint").alias("date_sk"), F.year(d).alias("year"), dates.month_of(d).alias("month"), F.month(d).alias("month_number"), F.dayofmonth(d).alias("day"),
        dates.quarter_of(d).alias("quarter"), dates.half_of(d).alias("half"), (F.last_day(d) == d).alias("is_month_end"),
    ]


def calendar_of(df: DataFrame, date: str) -> DataFrame:
    """calendar() over the whole years in which ``df`` has dates, with how many of its rows each day has; none without a date."""
    day = F.to_date(date)
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("z")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence(F.trunc("a", "year"), F.date_sub(F.add_months(F.trunc("z", "year"), 12), 1))).alias("d"))
    seen = df.where(day.isNotNull()).groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    return days.join(seen, "d", "left").select(*_day(F.col("d")), F.coalesce("rows", F.lit(0)).alias("rows"))


def state_history(log: DataFrame, entity: str, day: str, order: list[str], columns: list[str], column: str = "column", value: str = "value") -> DataFrame:
    """(entity, version, effective_from, effective_to, is_current, *columns) of a log of single changes.

    A log row sets ``column`` to ``value``, which may be null. Of several changes of a column on one day the last by
    ``order`` wins; days that set some columns only carry the others over, and days that change nothing make no version.
    A log of any number of rows is one row for each (entity, day) before it is sorted. Other columns' rows, and rows
    without an entity or a day, are left out; a column is null until it is first set.
    """
    known = log.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(column).isin(columns))
    # A struct around the value tells a null that was set from one that wasn't.
    last = [F.max_by(F.when(F.col(column) == c, F.struct(F.col(value).alias("v"))), F.when(F.col(column) == c, F.struct(*order))).alias(c) for c in columns]
    daily = known.groupBy(entity, F.to_date(day).alias("__day")).agg(*last)
    along = W.partitionBy(entity).orderBy("__day").rowsBetween(W.unboundedPreceding, 0)
    states = daily.select(entity, "__day", *[F.last(c, ignorenulls=True).over(along).getField("v").alias(c) for c in columns])
    runs = islands(states, entity, ["__day"], columns).drop("last_seen", "observations")
    return closed(runs, entity).select(entity, "version", "effective_from", "effective_to", "is_current", *columns)


def observed_combinations(df: DataFrame, columns: list[str], date: str) -> DataFrame:
    """A dimension of the observed combinations: valid from the first observation to the last, open if seen at the series' end."""
    seen = df.groupBy(*columns).agg(F.min(date).alias("valid_from"), F.max(date).alias("__last"))
    end = df.agg(F.max(date).alias("m")).first()["m"]
    return seen.select(*columns, "valid_from", F.when(F.col("__last") == F.lit(end), OPEN_END).otherwise(F.col("__last")).alias("valid_to"))


def first_by(df: DataFrame, keys: list[str], precedence: list) -> DataFrame:
    """One row for each key, the first by precedence."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*precedence))).where("__k = 1").drop("__k")
