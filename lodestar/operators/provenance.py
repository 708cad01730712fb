"""From an answer down to the source rows behind it, and what standardising did to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import lookups


def _meets(answer: list[str], by: list[str]):
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(answer, by, strict=True)])


def rows_behind(answer: DataFrame, facts: DataFrame, by: list[str], row_id: str, value: str, log: DataFrame | None = None) -> DataFrame:
    """(by.., row_id, value, changes, rules): every row of ``facts`` in a group that the answer shows.

    ``facts`` are the rows that the answer was computed from, with its filters. Null is a group like any other, and rows
    of groups that the answer withholds stay hidden. ``log`` has (row_id, rule), a row for each change that standardising
    made; ``changes`` counts a row's, ``rules`` names them in order. Without a log, and for rows never changed, they are 0
    and empty. A row id that several facts share gives a row for each, and each has all its changes.
    """
    keys = [f"__{k}" for k in range(len(by))]
    shown = lookups.small(answer.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).distinct())
    rows = facts.select(*by, row_id, value).join(shown, _meets(keys, by), "left_semi")
    if log is None:
        return rows.withColumns({"changes": F.lit(0).cast("bigint"), "rules": F.lit("")})
    made = log.where(F.col("row_id").isNotNull()).groupBy(F.col("row_id").alias("__id")).agg(F.count(F.lit(1)).alias("changes"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    found = rows.join(made, F.col(row_id) == F.col("__id"), "left").drop("__id")
    return found.withColumns({"changes": F.coalesce("changes", F.lit(0).cast("bigint")), "rules": F.coalesce("rules", F.lit(""))})


def explained(answer: DataFrame, traced: DataFrame, by: list[str], answered: str, value: str, within: float = 1e-6) -> DataFrame:
    """(by.., answered, traced, rows, changed, agrees): each answered group against the sum of the rows traced for it."""
    keys = [f"__{k}" for k in range(len(by))]
    sums = traced.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.sum(value).alias("traced"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("changes") > 0).alias("changed"))
    both = answer.select(*by, F.col(answered).alias("answered")).join(sums, _meets(keys, by), "left")
    near = F.abs(F.col("answered") - F.col("traced")) <= within * F.greatest(F.lit(1.0), F.abs("answered"))
    agrees = F.coalesce(near, F.col("answered").isNull() & F.col("traced").isNull())
    return both.select(*by, "answered", "traced", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), F.coalesce("changed", F.lit(0).cast("bigint")).alias("changed"), agrees.alias("agrees"))
