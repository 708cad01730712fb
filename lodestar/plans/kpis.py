"""Plans of metrics: the fact a metric is told from, what its contract fixes, and its values by period and dimensions.

A plan's conditions are part of the metric's contract and cannot be left out by a question. A metric without a plan has no
value at all; this is how one that is blocked stays without a number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans import metrics
from lodestar.specs import Metric


@dataclass(frozen=True)
class Plan:
    metric: Metric
    base: str  # the fact with its dimensions that the plan reads
    scope: str = ""  # a fixed condition on who counts
    declared: str = ""  # a fixed condition on what was declared: others leave both sides, and their share is told
    grains: tuple[str, ...] = ("quarter", "year")
    ends: str = ""  # the stock whose ends make a turnover's denominator


def _where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(F.expr(condition)) if condition else df


def evaluated(plan: Plan, bases: dict[str, DataFrame], grain: str, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """(plan, grain, period, *dimensions, value, numerator, denominator, population, undeclared).

    ``undeclared`` is the share of those in scope that declared nothing, null where a plan asks for no declaration.
    """
    if grain not in plan.grains or (extra := set(dimensions) - set(plan.metric.dimensions)):
        raise ValueError(f"{plan.metric.id} is not told by {grain if grain not in plan.grains else sorted(extra)}")
    m, base = plan.metric, _where(bases[plan.base], plan.scope)
    if m.measure == "turnover":
        rows = metrics.turnover(base, bases[plan.ends], grain, m.grain, m.value, m.population, dimensions)
    else:
        rows = metrics.evaluated(m, _where(base, plan.declared), grain, dimensions=dimensions)
    none = F.lit(None).cast("double")
    if plan.declared:
        seen = metrics.last_period_rows(base, m.grain, grain) if grain != m.grain and m.rollup == "last_period" else base
        of = F.count_distinct(m.population)
        share = 1 - F.count_distinct(F.when(F.expr(plan.declared), F.col(m.population))) / of
        told = seen.groupBy(F.col(grain).alias("__p"), *[F.col(d).alias(f"__{d}") for d in dimensions]).agg(F.round(share, 6).alias("undeclared"))
        match = F.col("period").eqNullSafe(F.col("__p"))
        for d in dimensions:
            match = match & F.col(d).eqNullSafe(F.col(f"__{d}"))
        rows = rows.join(told, match, "left")
    else:
        rows = rows.withColumn("undeclared", none)
    sides = [F.col(c) if c in rows.columns else none.alias(c) for c in ("numerator", "denominator")]
    return rows.select(F.lit(m.id).alias("plan"), F.lit(grain).alias("grain"), "period", *dimensions, F.col("value").cast("double").alias("value"), *sides, "population", "undeclared")
