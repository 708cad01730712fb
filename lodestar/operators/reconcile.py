"""Comparisons of two tellings of the same: monthly counts, recovered values, content hashes, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import cut


def monthly_deviation(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(month, ours, theirs, deviation) of months that both have; both frames have columns month and n."""
    a, b = ours.select("month", F.col("n").alias("ours")), theirs.select("month", F.col("n").alias("theirs"))
    return a.join(b, "month").withColumn("deviation", F.round((F.col("ours") - F.col("theirs")) / F.col("theirs"), 6))


def recovery(told: DataFrame, truth: DataFrame, key: str, told_value: str, true_value: str, unmapped: str = "UNMAPPED") -> DataFrame:
    """(rows, recovered, unmapped, divergent, recovered_rate) of told values against the true ones, by key."""
    t = truth.select(F.col(key).alias("__key"), F.col(true_value).alias("__true"))
    both = told.join(t, told[key] == t["__key"])
    v = F.col(told_value)
    hit, out = v == F.col("__true"), v == unmapped
    sums = both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("recovered"), F.count_if(out).alias("unmapped"), F.count_if(~F.coalesce(hit, F.lit(False)) & ~F.coalesce(out, F.lit(False))).alias("divergent"))
    return sums.withColumn("recovered_rate", F.round(F.try_divide("recovered", "rows"), 6))


def six_decimals(c: Column) -> Column:
    """A double with six decimals as C's printf tells it: its exact value is rounded, and a tie goes to the even digit.

    Java rounds the shortest text of a double, and ties away from zero. Where that would be wrong, the value goes one step
    towards zero first. Twice a million times the value is told exactly as a product and its error (Dekker), an odd number
    is a tie. From 2^31 on the whole part is told apart; from 2^63 on digits are Java's.
    """
    v = c.cast("double")

    def rounded(x: Column) -> Column:
        a = F.abs(x)
        high = a * 134217729.0 - (a * 134217729.0 - a)
        product = a * 2e6
        tie = F.rint(product)
        off = (product - tie) + ((high * 2e6 - product) + (a - high) * 2e6)
        down = (tie % 2 == 1) & ((off < 0) | ((off == 0) & (tie % 4 == 1)))
        return F.format_string("%.6f", x * F.when(down, 1 - 2.0**-52).otherwise(1.0))

    whole = F.floor(F.abs(v))
    part = rounded(F.abs(v) - whole)
    far = F.concat(F.when(v < 0, "-").otherwise(""), (whole + F.substring(part, 1, 1).cast("bigint")).cast("string"), F.substring(part, 2, 7))
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(F.abs(v) < 2.0**31, rounded(v)).when(F.abs(v) < 2.0**63, far).otherwise(F.coalesce(odd, F.format_string("%.6f", v)))


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text, the same in any engine: six decimals of a fraction, seconds of a time, values of an array by commas."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(c, lambda x: as_text(x, kind.elementType)), ",", "?")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = six_decimals(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        text = c.cast("string")
    return F.when(c.isNotNull(), text)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, columns, hash) of a table, whatever the order of its rows and columns: the sum of 60 bits of each row's MD5."""
    names = sorted(df.columns)
    row = F.concat_ws("\x1f", *[F.coalesce(as_text(df[c], df.schema[c].dataType), F.lit("?")) for c in names])
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(names)).alias("columns"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash"))


def provenance(manifests: dict[str, dict], keys: tuple[str, ...] = ("seed", "profile", "scale")) -> dict:
    """Whether all manifests agree on ``keys``; what differs otherwise, pair by pair."""
    names = sorted(manifests)
    differs = [(a, b, k) for i, a in enumerate(names) for b in names[i + 1 :] for k in keys if manifests[a].get(k) != manifests[b].get(k)]
    return {"status": "DIVERGENT" if differs else "OK", "differs": differs}


def first_rule(rules: list[tuple[str, str, object]], otherwise: str = "UNDETERMINED"):
    """struct(code, rule) of the first rule (rule, code, condition) that holds."""
    code, rule = F.lit(otherwise), F.lit("NONE")
    for name, value, condition in reversed(rules):
        code, rule = F.when(condition, value).otherwise(code), F.when(condition, name).otherwise(rule)
    return F.struct(code.alias("code"), rule.alias("rule"))


def cycles(spark, edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node) of each node on a cycle of the parent relation, however long chains, tails and cycles are.

    Pointers jump: each round doubles the steps that a pointer takes, so the longest chain of n costs log2(n) joins. The
    nodes that are still pointed at only become fewer; when a round leaves as many, the pointers map them onto themselves,
    and each is on a cycle.
    """
    up = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("n"), F.col(parent).alias("p"))
    jump = cut(up.groupBy("n").agg(F.min("p").alias("p")))
    reached = jump.agg(F.count_distinct("p")).first()[0]
    while reached:
        jump = cut(jump.join(jump.select(F.col("n").alias("p"), F.col("p").alias("q")), "p").select("n", F.col("q").alias("p")))
        before, reached = reached, jump.agg(F.count_distinct("p")).first()[0]
        if reached == before:
            break
    return jump.select(F.col("p").alias("node")).distinct()


def worst(deviations: DataFrame) -> DataFrame:
    """(months, mean_deviation, most_deviation, worst_month) of monthly_deviation(): by absolute values, the first of equals."""
    size = F.abs("deviation")
    return deviations.agg(
        F.count("deviation").alias("months"), F.round(F.avg(size), 6).alias("mean_deviation"), F.max(size).alias("most_deviation"),
        F.max(F.when(F.col("deviation").isNotNull(), F.struct(size.alias("s"), (-F.unix_date(F.to_date(F.concat("month", F.lit("-01"))))).alias("d"), F.col("month"))))["month"].alias("worst_month"),
    )


def orphans(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows whose parent is named but is no row's key. Keys are counted once, so nothing multiplies."""
    keys = df.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct()
    return df.where(F.col(parent).isNotNull()).join(keys, F.col(parent) == F.col("__key"), "left_anti")


def coverage(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """For each key of any source: (key, rows_<source>.., missing, verdict). A full merge of any number of sources.

    ``missing`` lists the sources that lack the key, in their order. verdict: COMPLETE, ONLY_<source> if a single one has it,
    else LACKS_<source>_<source>... Keys are compared as text and counted by source before they meet, so this is one
    shuffle of at most a row for each (source, key, task), however many sources there are. Null keys are left out.
    """
    names = list(sources)
    tagged = [df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.lit(n).alias("source")) for n, df in sources.items()]
    counted = reduce(DataFrame.unionByName, tagged).groupBy("key").agg(*[F.count_if(F.col("source") == n).alias(f"rows_{n}") for n in names])
    missing = F.array_compact(F.array(*[F.when(F.col(f"rows_{n}") == 0, F.lit(n)) for n in names]))
    out = counted.withColumn("missing", missing)
    single = F.concat(F.lit("ONLY_"), F.array_join(F.array_except(F.array(*[F.lit(n) for n in names]), "missing"), ""))
    verdict = F.when(F.size("missing") == 0, "COMPLETE").when(F.size("missing") == len(names) - 1, single).otherwise(F.concat(F.lit("LACKS_"), F.array_join("missing", "_")))
    return out.withColumn("verdict", verdict)


def coverage_summary(covered: DataFrame) -> DataFrame:
    """(verdict, keys, share) of coverage()."""
    counts = covered.groupBy("verdict").agg(F.count(F.lit(1)).alias("keys"))
    total = counts.agg(F.sum("keys").alias("__all"))
    return counts.join(F.broadcast(total)).select("verdict", "keys", F.round(F.col("keys") / F.col("__all"), 6).alias("share"))
