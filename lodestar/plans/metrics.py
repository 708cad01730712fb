"""Metrics over a base view: measure and population by period and dimensions, roll-ups, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.specs import Metric

FINENESS = {"month": 0, "quarter": 1, "half": 2, "year": 3}


def measured(metric: Metric) -> list[Column]:
    """The measure's columns: value, and numerator and denominator of a ratio. Distinct counts are exact."""
    v = F.col(metric.value) if metric.value else None
    if metric.measure == "distinct":
        return [F.count_distinct(v).cast("double").alias("value")]
    if metric.measure == "sum":
        return [F.sum(v.cast("decimal(28,2)")).cast("double").alias("value")]
    if metric.measure == "median":
        return [F.median(v).alias("value")]
    if metric.measure == "ratio":
        over, under = F.sum(v.cast("decimal(28,2)")).cast("double"), F.sum(F.col(metric.over).cast("decimal(28,2)")).cast("double")
    elif metric.measure == "distinct_ratio":
        over, under = F.count_distinct(v).cast("double"), F.count_distinct(F.col(metric.over)).cast("double")
    else:
        raise ValueError(f"{metric.id}: no measure {metric.measure}")
    return [F.try_divide(over, under).alias("value"), over.alias("numerator"), under.alias("denominator")]


def last_period_rows(base: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Rows of the last fine period within each coarse one, whatever is filtered later. The calendar bounds what is broadcast."""
    periods = base.select(F.col(coarse).alias("__c"), F.col(fine).alias("__f")).distinct()  # hashed, where a maximum of texts would sort all rows
    last = periods.groupBy("__c").agg(F.max("__f").alias("__last"))
    return base.join(F.broadcast(last), (base[coarse] == F.col("__c")) & (base[fine] == F.col("__last")), "left_semi")


def _medians(metric: Metric, base: DataFrame, groups: list[Column], names: list[str]) -> DataFrame:
    """Medians from counts of equal values: beside a distinct count they would carry a buffer for each member of the population."""
    counts = base.groupBy(*groups, F.col(metric.value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    members = base.groupBy(*groups).agg(F.count_distinct(metric.population).alias("population"))
    both = counts.unionByName(members, allowMissingColumns=True)
    return both.groupBy(*names).agg(F.percentile("__v", 0.5, F.col("__n")).alias("value"), F.max("population").alias("population"))


def evaluated(metric: Metric, base: DataFrame, grain: str, periods: tuple[str, str] | None = None, dimensions: tuple[str, ...] = (), filters: dict[str, list] | None = None) -> DataFrame:
    """(period, *dimensions, measure, population): the base has columns month, quarter, half, year and the metric's own.

    Stock metrics take the last month of a coarser period before any filter; flows regroup, so medians and ratios are
    computed anew and never summed.
    """
    if grain != metric.grain and metric.rollup == "last_period":
        base = last_period_rows(base, metric.grain, grain)
    if periods:
        base = base.where(F.col(grain).between(*periods))
    for c, members in (filters or {}).items():
        base = base.where(F.col(c).isin(list(members)))
    groups = [F.col(grain).alias("period"), *[F.col(c) for c in dimensions]]
    if metric.measure == "median":
        return _medians(metric, base, groups, ["period", *dimensions])
    return base.groupBy(*groups).agg(*measured(metric), F.count_distinct(metric.population).alias("population"))


def turnover(exits: DataFrame, stock: DataFrame, period: str, month: str, exit_id: str, entity: str, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Exits over the mean of the entities in the period's first and last observed months, by group.

    A group without exits has no row; groups match also where a dimension is null.
    """
    left = exits.groupBy(F.col(period).alias("period"), *dimensions).agg(F.count_distinct(exit_id).cast("double").alias("numerator"), F.count_distinct(entity).alias("population"))
    by_month = stock.groupBy(F.col(period).alias("__p"), *[F.col(d).alias(f"__{d}") for d in dimensions], F.col(month).alias("__m")).agg(F.count_distinct(entity).alias("__n"))
    ends = by_month.groupBy("__p", *[f"__{d}" for d in dimensions]).agg(((F.min_by("__n", "__m") + F.max_by("__n", "__m")) / 2.0).alias("denominator"))
    match = F.col("period") == F.col("__p")
    for d in dimensions:
        match = match & F.col(d).eqNullSafe(F.col(f"__{d}"))
    return left.join(ends, match, "left").select("period", *dimensions, F.try_divide("numerator", "denominator").alias("value"), "numerator", "denominator", "population")


def protected(rows: DataFrame, minimum_n: int, within: list[str], order: list[str], hide: tuple[str, ...] = ("value", "population")) -> DataFrame:
    """``rows`` with suppression: no, primary or complementary.

    A row of fewer than ``minimum_n`` is suppressed. Where that is exactly one row of a group of several, it could be
    had by subtraction, so the smallest other row goes too (of equals the first by ``order``). Keys stay, values are null.
    Results are a breakdown's rows, not facts, so each group is small.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    below = F.coalesce(F.col("population"), F.lit(0)) < minimum_n
    marked = rows.withColumn("__below", below).withColumn("__n", F.sum(F.col("__below").cast("int")).over(group)).withColumn("__rows", F.count(F.lit(1)).over(group))
    marked = marked.withColumn("__rank", F.row_number().over(group.orderBy("__below", "population", *order)))
    why = F.when(F.col("__below"), "primary").when((F.col("__n") == 1) & (F.col("__rows") >= 2) & (F.col("__rank") == 1), "complementary").otherwise("no")
    marked = marked.withColumn("suppression", why)
    return marked.select(*[F.when(F.col("suppression") == "no", F.col(c)).alias(c) if c in hide else F.col(c) for c in rows.columns], "suppression")


def compared(now: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """now, base, delta, relative_delta and direction of two results by ``on``."""
    b = base.select(*on, F.col("value").alias("base"))
    delta = F.col("value") - F.col("base")
    direction = F.when(delta > 0, "UP").when(delta < 0, "DOWN").when(delta == 0, "STABLE")
    return now.join(b, on).select(*on, "value", "base", delta.alias("delta"), F.round(F.try_divide(delta, F.col("base")), 6).alias("relative_delta"), direction.alias("direction"))
