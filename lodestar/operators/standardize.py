"""Standardising staged text: cleaned columns beside parsed ones, and a log of every value that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import dates, text
from lodestar.specs import StandardSpec

#: The chain of rules, in order.
RULES: tuple = (("EMPTY_TO_NULL", text.empty_to_null), ("TRIM", text.trimmed), ("COLLAPSE", text.collapsed))
ENCODING = ("ENCODING_REPAIR", text.repaired_encoding)


def steps(c: Column, repair: bool) -> list[tuple[str, Column]]:
    out = []
    for name, rule in (*RULES, *([ENCODING] if repair else [])):
        c = rule(c)
        out.append((name, c))
    return out


def standardized(df: DataFrame, spec: StandardSpec, year_now: int) -> DataFrame:
    """``df`` with every text column cleaned, and __iso, __num, __parse, __ambiguous of dates and decimals."""
    kinds = dict(df.dtypes)
    clean = df.select(*[steps(F.col(c), c in spec.texts)[-1][1].alias(c) if kinds[c] == "string" and c != "_row_id" else F.col(c) for c in df.columns])
    parsed = {c: dates.parsed_date(F.col(c), f, year_now) for c, f in spec.dates.items()}
    clean = clean.withColumns({f"{c}__p": p for c, p in parsed.items()} | {f"{c}__p": text.parsed_decimal(F.col(c)) for c in spec.decimals})
    extra = {f"{c}__{k}": F.col(f"{c}__p.{k}") for c in spec.dates for k in ("iso", "parse", "ambiguous")} | {f"{c}__{k}": F.col(f"{c}__p.{k}") for c in spec.decimals for k in ("num", "parse")}
    return clean.withColumns(extra).drop(*[f"{c}__p" for c in (*spec.dates, *spec.decimals)])


def change_log(df: DataFrame, columns: list[str], repair: tuple[str, ...] = (), row_id: str = "_row_id") -> DataFrame:
    """(row_id, column, rule, old, new): one row for each rule that changed a value, in one scan."""
    entries = []
    for c in columns:
        before = F.col(c)
        for name, after in steps(before, c in repair):
            old = before
            entries.append(F.when(~old.eqNullSafe(after), F.struct(F.lit(c).alias("column"), F.lit(name).alias("rule"), old.alias("old"), after.alias("new"))))
            before = after
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("row_id", "e.*")


def rule_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("rule").agg(F.count(F.lit(1)).alias("values"))
