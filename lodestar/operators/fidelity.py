"""Raw tables against the truth that they were made of, less the ledger of declared defects, and rules for the ledger itself.

Results of rules have the columns of invariants: rule, severity, evaluated, violations, measure, allowed, passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.invariants import BLOCKER, CRITICAL

#: Fixed: the columns of lineage that every landed table has.
TECHNICAL = ("_source_file", "_row_number", "_ingested_at", "_source_system")
#: What the ledger writes for a column that a source doesn't have.
NO_COLUMN = "(no column)"
_OUT = "rule string, severity string, evaluated bigint, violations bigint, measure double, allowed double, passed boolean"


def compared(raw: DataFrame, truth: DataFrame, key: str, columns: dict[str, str], ledger: DataFrame) -> DataFrame:
    """A row for each key of either side: ``differences``, array of (column, kind, raw, truth, declared).

    ``columns`` maps columns of the truth to those of the raw table; values are compared as text, nulls being equal. kind is
    DIFFERENT, MISSING (a true record that the raw side lacks), EXTRA (a raw record without a true one) or REPEATED (a raw
    key that stands several times; its least values are compared). The ledger has key, column (null: the whole record).

    All three sides meet in one aggregate by key, so wide rows are shuffled once, whatever the number of columns; the
    truth's keys are unique. Rows without a key are left out, and what the ledger tells of keys that neither side has.
    """
    of = lambda df, name, *more: df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("key"), *more)
    mine = of(raw, key, F.lit(1).alias("rows"), *[F.col(c).cast("string").alias(f"r_{k}") for k, c in enumerate(columns.values())])
    theirs = of(truth, key, F.lit(True).alias("true"), *[F.col(c).cast("string").alias(f"t_{k}") for k, c in enumerate(columns)])
    told = of(ledger, "key", F.coalesce("column", F.lit("")).alias("said"))
    sides = mine.unionByName(theirs, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    met = sides.groupBy("key").agg(F.sum("rows").alias("rows"), F.max("true").alias("true"), F.collect_set("said").alias("said"), *[F.min(f"r_{k}").alias(f"r_{k}") for k in range(len(columns))], *[F.max(f"t_{k}").alias(f"t_{k}") for k in range(len(columns))])
    met = met.where(F.col("rows").isNotNull() | F.col("true").isNotNull()).withColumn("said", F.when(F.size("said") > 0, F.col("said")))
    whole = F.coalesce(F.array_contains("said", ""), F.lit(False))

    def entry(column: str, kind: str, when: Column, a: Column, b: Column) -> Column:
        declared = whole | F.coalesce(F.array_contains("said", column), F.lit(False)) if column else whole
        return F.when(when, F.struct(F.lit(column or None).cast("string").alias("column"), F.lit(kind).alias("kind"), a.alias("raw"), b.alias("truth"), declared.alias("declared")))

    none, both = F.lit(None).cast("string"), F.col("rows").isNotNull() & F.col("true").isNotNull()
    found = [entry(c, "DIFFERENT", both & ~F.col(f"r_{k}").eqNullSafe(F.col(f"t_{k}")), F.col(f"r_{k}"), F.col(f"t_{k}")) for k, c in enumerate(columns)]
    found += [entry("", "MISSING", F.col("rows").isNull(), none, none), entry("", "EXTRA", F.col("true").isNull(), none, none), entry("", "REPEATED", F.coalesce(F.col("rows") > 1, F.lit(False)), none, none)]
    return met.select("key", both.alias("both"), "said", F.array_compact(F.array(*found)).alias("differences"))


def undeclared(met: DataFrame) -> DataFrame:
    """(key, column, kind, raw, truth) of the differences of compared() that the ledger doesn't tell."""
    each = met.select("key", F.explode("differences").alias("d")).where("NOT d.declared")
    return each.select("key", "d.column", "d.kind", "d.raw", "d.truth")


def silent(met: DataFrame) -> DataFrame:
    """(key, column) that the ledger tells and the tables don't show."""
    told = F.transform("differences", lambda d: F.coalesce(d["column"], F.lit("")))
    each = met.where("said IS NOT NULL").select("key", F.explode(F.array_except("said", told)).alias("column"))
    return each.select("key", F.nullif("column", F.lit("")).alias("column"))


def _result(df: DataFrame, rule: str, severity: str, evaluated: Column, violations: Column, measure: Column | None = None, allowed: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    bad = F.coalesce(violations, F.lit(0)).cast("bigint")
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(evaluated, F.lit(0)).cast("bigint").alias("evaluated"), bad.alias("violations"), (none if measure is None else measure).cast("double").alias("measure"), (none if allowed is None else allowed).cast("double").alias("allowed"), (bad == 0).alias("passed"))


def faithful(met: DataFrame) -> DataFrame:
    """Two rules from one aggregate: what isn't declared equals the truth (of keys on both sides), what is declared shows."""
    left = F.size(F.filter("differences", lambda d: ~d["declared"]))
    told = F.transform("differences", lambda d: F.coalesce(d["column"], F.lit("")))
    mute = F.size(F.array_except("said", told))
    total = met.select("both", left.alias("left"), F.size(F.coalesce("said", F.array().cast("array<string>"))).alias("said"), F.when(F.col("said").isNull(), 0).otherwise(mute).alias("mute"))
    total = total.agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("left"), F.sum("said").alias("said"), F.sum("mute").alias("mute"))
    return _result(total, "undeclared_equals_truth", BLOCKER, F.col("n"), F.col("left")).unionByName(_result(total, "declared_shows", BLOCKER, F.col("said"), F.col("mute")))


def in_catalogue(ledger: DataFrame, catalogue: DataFrame, systems: list[str]) -> DataFrame:
    """Three rules for a ledger (defect_id, source_system, ..) counted once: its systems are known ones, its defects are in the
    catalogue (defect_id, source_system), and each defect of the catalogue is seen."""
    seen = ledger.groupBy("defect_id", "source_system").agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(catalogue.select("defect_id", "source_system", F.lit(True).alias("known")).distinct(), ["defect_id", "source_system"], "full")
    total = both.agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.coalesce(F.col("source_system").isin(systems), F.lit(False)), F.col("n"))).alias("elsewhere"), F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("unknown"),
        F.count("known").alias("known"), F.count_if(F.col("n").isNull()).alias("unseen"),
    )
    rules = (("ledger_of_these_systems", "n", "elsewhere"), ("ledger_in_catalogue", "n", "unknown"), ("catalogue_seen", "known", "unseen"))
    return reduce(DataFrame.unionByName, [_result(total, rule, BLOCKER, F.col(n), F.col(bad)) for rule, n, bad in rules])


def absent_columns(ledger: DataFrame, defect: str) -> DataFrame:
    """A defect of a missing column is told as such, once at least, and never with a value."""
    total = ledger.where(F.col("defect_id") == defect).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("raw_value").contains(NO_COLUMN), F.lit(False))).alias("bad"))
    return _result(total, f"{defect}_is_a_missing_column", BLOCKER, F.col("n"), F.when(F.col("n") == 0, 1).otherwise(F.col("bad")))


def in_window(ledger: DataFrame, defect: str, records: DataFrame, key: str, date: str, window: tuple[str, str]) -> DataFrame:
    """Records with a defect that is bound to a time are of that time: ``date`` is at most the window's end, as what began
    before it counts from its start. Ledger keys are counted before they meet the records; unknown ones say nothing."""
    hit = ledger.where(F.col("defect_id") == defect).groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    when = records.select(F.col(key).cast("string").alias("key"), F.greatest(F.to_date(date), F.lit(window[0]).cast("date")).alias("at"))
    total = hit.join(when, "key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("at") > F.lit(window[1]).cast("date"), F.col("n"))).alias("bad"))
    return _result(total, f"{defect}_in_its_window", BLOCKER, F.col("n"), F.col("bad"))


def of_count(ledger: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Defects of an absolute count are as many, within 2 or a tenth."""
    seen = [F.count_if(F.col("defect_id") == d).alias(d) for d in expected]
    total = ledger.agg(*seen)
    rules = [_result(total, f"{d}_count", BLOCKER, F.col(d), (F.abs(F.col(d) - n) > max(2, 0.1 * n)).cast("bigint"), F.col(d), F.lit(float(n))) for d, n in expected.items()]
    return reduce(DataFrame.unionByName, rules)


def alike(ours: DataFrame, theirs: DataFrame, rates: tuple[float, float]) -> DataFrame:
    """Two populations differ by a rate between half the least and twice the most of what is configured."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))  # noqa: E731  a row each
    both = n(ours, "a").crossJoin(n(theirs, "b"))
    rate = F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("b"))
    return _result(both, "populations_differ_as_configured", CRITICAL, F.col("b"), (~rate.between(0.5 * rates[0], 2 * rates[1])).cast("bigint"), F.round(rate, 6), F.lit(2 * rates[1]))


def of_schema(spark, schemas: dict[str, T.StructType], required: tuple[str, ...] = TECHNICAL, forbidden: dict[str, tuple[str, ...]] | None = None, present: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rules on schemas alone, no row is read: every table has the technical columns; some lack all columns that begin with
    a forbidden word, and have the columns they must."""
    rows = []

    def add(rule: str, names: list[str], bad: int) -> None:
        rows.append((rule, BLOCKER, len(names), bad, None, None, bad == 0))

    add("technical_columns", list(schemas), sum(not set(required) <= set(s.names) for s in schemas.values()))
    for name, starts in (forbidden or {}).items():
        add(f"{name}_lacks_{'_'.join(starts)}", schemas[name].names, sum(c.lower().startswith(tuple(starts)) for c in schemas[name].names))
    for name, columns in (present or {}).items():
        add(f"{name}_has_{'_'.join(columns)}", schemas[name].names, len(set(columns) - set(schemas[name].names)))
    return spark.createDataFrame(rows, _OUT)
