"""Data-quality expectations, compiled: all row rules of a dataset and all its cuts in one aggregate.

An expectation gives (evaluated, failed). A missing column or nothing evaluated is NOT_RUN, never PASS. All rules over keys
(uniqueness, references, identities) and their cuts share one scan of each dataset and one aggregate by key, so a key that
repeats a million times is a row for each task by the time it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import trimmed
from lodestar.specs import Check

ROW_KINDS = ("not_null", "not_in_set", "in_set", "not_equal", "between", "match", "not_match", "length_between", "parse_ok", "not_ambiguous", "date_between", "before")
GROUP_KINDS = ("distinct_between", "mean_between", "max_date_after")
KEY_KINDS = ("unique", "compound_unique", "in_reference", "identity_resolved")
ALL_KINDS = (*ROW_KINDS, *GROUP_KINDS, *KEY_KINDS, "month_gap_below", "row_ratio", "group_ratio", "sum_ratio")


def scope(df: DataFrame, rule: dict | None) -> Column:
    """The rows a check is about: {column, equals, in, min, max}; all conditions hold, the value is not null, bounds count."""
    if not rule:
        return F.lit(True)
    if rule["column"] not in df.columns:
        return F.lit(False)
    c = F.col(rule["column"])
    parts = [c.isNotNull()]
    if "equals" in rule:
        parts.append(c == rule["equals"])
    if "in" in rule:
        parts.append(c.isin(list(rule["in"])))
    if "min" in rule:
        parts.append(c >= rule["min"])
    if "max" in rule:
        parts.append(c <= rule["max"])
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def scoped(df: DataFrame, rule: dict | None) -> DataFrame:
    return df.where(scope(df, rule))


def row_rule(check: Check) -> tuple[Column, Column]:
    """(evaluated, failed) of a row."""
    c, a, k = F.col(check.column), check.args, check.kind
    some = c.isNotNull()
    if k == "not_null":
        return F.lit(True), c.isNull()
    if k == "not_in_set":
        return some, trimmed(c.cast("string")).isin(list(a["values"]))
    if k == "in_set":
        return some, ~trimmed(c.cast("string")).isin(list(a["values"]))
    if k == "not_equal":
        return some, c == a["value"]
    if k == "between":
        return some, (c < a.get("min", float("-inf"))) | (c > a.get("max", float("inf")))
    if k == "match":
        return some, ~c.rlike(a["regex"])
    if k == "not_match":
        return some, c.rlike(a["regex"])
    if k == "length_between":
        n = F.char_length(trimmed(c))
        return some, (n < a.get("min", 0)) | (n > a.get("max", 2**31 - 1))
    if k == "parse_ok":
        parse = F.col(f"{check.column}__parse")
        return parse != "empty", parse != "ok"
    if k == "not_ambiguous":
        return F.lit(True), F.col(f"{check.column}__ambiguous")
    if k == "date_between":
        return some & (c != ""), (c < a.get("min", "")) | (c > a.get("max", "9999-12-31"))
    if k == "before":
        other = F.col(a["other"])
        return some & other.isNotNull(), other < c
    raise ValueError(f"{check.id}: no row rule {k}")


def _needs(check: Check) -> list[str]:
    if check.kind == "parse_ok":
        return [f"{check.column}__parse"]
    if check.kind == "not_ambiguous":
        return [f"{check.column}__ambiguous"]
    return [*([check.column] if check.column else []), *([check.args["other"]] if "other" in check.args else []), *check.args.get("columns", ())]


def _pair(evaluated: Column, failed: Column) -> tuple[Column, Column]:
    return F.count_if(evaluated), F.count_if(evaluated & F.coalesce(failed, F.lit(False)))


def _group_rule(check: Check, within: Column) -> tuple[Column, Column]:
    c, a = F.when(within, F.col(check.column)), check.args
    rows = F.count_if(within)
    if check.kind == "distinct_between":
        n = F.count_distinct(c)
        return rows, (~n.between(a["min"], a["max"])).cast("bigint")
    if check.kind == "mean_between":
        m = F.avg(c)
        return F.count(c), F.coalesce((~m.between(a["min"], a["max"])).cast("bigint"), F.lit(0))
    return rows, F.coalesce((F.max(c) < a["min"]).cast("bigint"), F.lit(0))


def _result(check: Check, df: DataFrame, cut: list[str]) -> DataFrame:
    """Columns check_id, *cut, evaluated, failed from a frame that has evaluated and failed."""
    return df.select(F.lit(check.id).alias("check_id"), *cut, F.col("evaluated").cast("bigint").alias("evaluated"), F.col("failed").cast("bigint").alias("failed"))


def _one(check: Check, frames: dict[str, DataFrame], cut: list[str]) -> DataFrame:
    """Checks that need rows of a key together, or a second dataset."""
    df, a = scoped(frames[check.dataset], check.scope), check.args
    if check.kind == "month_gap_below":
        months = df.where(F.col(check.column).isNotNull()).select(*cut, F.substring(check.column, 1, 7).alias("m")).distinct()
        at = F.substring("m", 1, 4).cast("int") * 12 + F.substring("m", 6, 2).cast("int")
        order = W.partitionBy(*cut).orderBy("at") if cut else W.partitionBy(F.lit(0)).orderBy("at")
        gaps = months.select(*cut, at.alias("at")).withColumn("gap", F.col("at") - F.lag("at").over(order))
        counted = gaps.groupBy(*cut).agg(F.count(F.lit(1)).alias("evaluated"), (F.max("gap") > a["most"]).cast("bigint").alias("failed")).where("evaluated >= 2")
        return _result(check, counted, cut)
    other = scoped(frames[a["reference"]], a.get("reference_scope"))
    if check.kind == "group_ratio":
        ours = df.where(F.col(check.column).isNotNull()).groupBy(F.substring(check.column, 1, 7).alias("m")).agg(F.count(F.lit(1)).alias("n"))
        theirs = other.where(F.col(a["column"]).isNotNull()).groupBy(F.substring(a["column"], 1, 7).alias("m")).agg(F.count(F.lit(1)).alias("r"))
        out = ours.join(theirs, "m").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(~(F.col("n") / F.col("r")).between(a["min"], a["max"])).alias("failed"))
        return _result(check, out, cut)
    if check.kind in ("row_ratio", "sum_ratio"):
        size = F.count(F.lit(1)) if check.kind == "row_ratio" else F.sum(F.col(check.column).cast("decimal(28,2)"))
        ref = F.count(F.lit(1)) if check.kind == "row_ratio" else F.sum(F.col(a["column"]).cast("decimal(28,2)"))
        ours = df.agg(F.count(F.lit(1)).alias("evaluated"), size.cast("double").alias("n"), F.lit(0).alias("k"))
        theirs = other.agg(ref.cast("double").alias("r"), F.lit(0).alias("k"))
        ratio = F.try_divide(F.col("n"), F.col("r"))
        return _result(check, ours.join(theirs, "k").select("evaluated", F.coalesce((~ratio.between(a["min"], a["max"])).cast("bigint"), F.lit(1)).alias("failed")), cut)
    raise ValueError(f"{check.id}: no rule {check.kind}")


def _key_entries(check: Check, within: Column, by: list[str]) -> list[tuple[str, Column]]:
    """(dataset, entry or null) of each use that a key rule makes of a row: a key of the check's own rows, for the whole and
    for each cut, or a key that they are held against."""
    a = check.args
    keys = [*a.get("columns", ())] or [check.column]
    entry = lambda when, cut, key, n, good, known: F.when(when, F.struct(F.lit(check.id).alias("check_id"), cut.alias("cut"), key.alias("key"), F.lit(n).cast("bigint").alias("n"), F.lit(good).alias("good"), F.lit(known).alias("known")))
    full = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    key = F.when(full, F.array(*[F.col(k).cast("string") for k in keys]))
    unique = check.kind in ("unique", "compound_unique")
    cuts = [F.lit("ALL"), *[F.concat(F.lit(f"{b}="), F.coalesce(F.col(b).cast("string"), F.lit(""))) for b in by if check.kind != "identity_resolved"]]
    out = [(check.dataset, entry(within if unique else within & full, cut, key, 1, False, False)) for cut in cuts]
    if check.kind == "in_reference":
        out.append((a["reference"], entry(F.col(a["column"]).isNotNull(), F.lit(None).cast("string"), F.array(F.col(a["column"]).cast("string")), 0, True, True)))
    if check.kind == "identity_resolved":
        mine, to = F.col("source_system") == a["system"], F.array(F.col("source_id").cast("string"))
        for good in (True, False):
            out.append((a["reference"], entry(mine & F.col("source_id").isNotNull() & ((F.col("match_status") == "RESOLVED").eqNullSafe(F.lit(good))), F.lit(None).cast("string"), to, 0, good, True)))
    return out


def key_rules(checks: list[Check], frames: dict[str, DataFrame], cuts: dict[str, list[str]]) -> DataFrame:
    """check_id, cut, evaluated, failed of all uniqueness, reference and identity checks with all their cuts.

    Each dataset is read once: a row goes out as an entry for each (check, cut, key), and as a key that others are held
    against. Entries are counted by (check, key, cut) before they are shuffled, and a key's cuts, of which there are no more
    than the cut columns have values, meet its reference in a second, smaller aggregate.
    """
    entries: dict[str, list[Column]] = {}
    for c in checks:
        for dataset, entry in _key_entries(c, scope(frames[c.dataset], c.scope), cuts.get(c.dataset, [])):
            entries.setdefault(dataset, []).append(entry)
    parts = [frames[name].select(F.explode(F.array_compact(F.array(*some))).alias("e")).select("e.*") for name, some in entries.items()]
    counted = reduce(DataFrame.unionByName, parts).groupBy("check_id", "key", "cut").agg(F.sum("n").alias("n"), F.max("good").alias("good"), F.max("known").alias("known"))
    met = counted.groupBy("check_id", "key").agg(F.max("good").alias("good"), F.max("known").alias("known"), F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("cut", "n"))).alias("cuts"))
    each = met.select("check_id", "key", "good", "known", F.explode("cuts").alias("c")).select("check_id", "key", "good", "known", "c.*")
    kind = F.create_map(*[F.lit(x) for c in checks for x in (c.id, c.kind)])[F.col("check_id")]
    bad = F.when(kind.isin("unique", "compound_unique"), F.col("key").isNotNull() & (F.col("n") > 1)).otherwise(~F.col("good"))
    summed = each.groupBy("check_id", "cut").agg(F.sum("n").alias("evaluated"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("failed"), F.max("known").alias("known"))
    # Keys of another kind say nothing: not run.
    summed = summed.where((kind != "identity_resolved") | F.col("known")).drop("known")
    every = counted.sparkSession.createDataFrame([(c.id, "ALL") for c in checks], "check_id string, cut string")
    return every.join(summed, ["check_id", "cut"], "full").select("check_id", "cut", "evaluated", "failed")


def with_identity(frames: dict[str, DataFrame], xref: DataFrame) -> dict[str, DataFrame]:
    """The frames, with the identity layer as two more datasets that checks can name.

    ``identity`` holds each entity once, for references; ``identity_xref`` the links with their status, for coverage.
    """
    known = xref.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    links = xref.select("source_system", F.col("source_id").cast("string").alias("source_id"), F.col("entity_id").cast("string").alias("entity_id"), "match_status")
    return frames | {"identity": known, "identity_xref": links}


def run(checks: list[Check], frames: dict[str, DataFrame], cuts: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each check, and for each value of each cut: evaluated, failed, rate, status.

    ``cuts`` gives a dataset's cut columns; each is a grouping set beside the whole. Without cuts there is no cut column.
    """
    parts, keyed = [], []
    for dataset in dict.fromkeys(c.dataset for c in checks):
        own = [c for c in checks if c.dataset == dataset]
        df, by = frames.get(dataset), (cuts or {}).get(dataset, [])
        missing = [c for c in own if df is None or set(_needs(c)) - set(df.columns)]
        own = [c for c in own if c not in missing]
        if missing:
            spark = next(iter(frames.values())).sparkSession
            rows = spark.createDataFrame([(c.id, None, None) for c in missing], "check_id string, evaluated bigint, failed bigint")
            parts.append(rows.withColumn("cut", F.lit("ALL")) if cuts is not None else rows)
        simple = [c for c in own if c.kind in ROW_KINDS or c.kind in GROUP_KINDS]
        if simple:
            named = []
            for c in simple:
                within = scope(df, c.scope)
                e, f = _group_rule(c, within) if c.kind in GROUP_KINDS else _pair(*(lambda r, w=within: (w & r[0], r[1]))(row_rule(c)))
                named.append(F.struct(F.lit(c.id).alias("check_id"), e.cast("bigint").alias("evaluated"), f.cast("bigint").alias("failed")))
            if by:
                grouped = df.groupingSets([[], *[[F.col(b)] for b in by]], *by)
                label = F.coalesce(*[F.when(F.grouping(b) == 0, F.concat(F.lit(f"{b}="), F.coalesce(F.col(b).cast("string"), F.lit("")))) for b in by], F.lit("ALL"))
                wide = grouped.agg(label.alias("cut"), F.array(*named).alias("r")).select("cut", F.explode("r").alias("r")).select("cut", "r.*")
            else:
                wide = df.agg(F.array(*named).alias("r")).select(F.explode("r").alias("r")).select("r.*")
                wide = wide.withColumn("cut", F.lit("ALL")) if cuts is not None else wide
            parts.append(wide)
        keyed += [c for c in own if c.kind in KEY_KINDS]
        for c in [c for c in own if c not in simple and c.kind not in KEY_KINDS]:
            out = _one(c, frames, [])
            parts.append(out.withColumn("cut", F.lit("ALL")) if cuts is not None else out)
            for b in by if c.kind == "month_gap_below" else ():
                parts.append(_one(c, frames, [b]).withColumn("cut", F.concat(F.lit(f"{b}="), F.coalesce(F.col(b).cast("string"), F.lit("")))).drop(b))
    if keyed:
        found = key_rules(keyed, frames, cuts or {})
        parts.append(found if cuts is not None else found.drop("cut"))
    spec = frames[next(iter(frames))].sparkSession.createDataFrame([(c.id, c.severity, c.finding, float(c.most)) for c in checks], "check_id string, severity string, finding string, most double")
    got = reduce(lambda x, y: x.unionByName(y), parts)
    if cuts is None:  # a check that could not run has a row too
        got = spec.select("check_id").join(got, "check_id", "left")
    got = got.join(F.broadcast(spec), "check_id")
    rate = F.round(F.col("failed") / F.nullif(F.col("evaluated"), F.lit(0)), 6)
    status = F.when(F.coalesce(F.col("evaluated"), F.lit(0)) == 0, "NOT_RUN").when(F.col("failed") / F.col("evaluated") <= F.col("most"), "PASS").otherwise("FAIL")
    return got.select("check_id", *(["cut"] if cuts is not None else []), "severity", "finding", F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("failed", F.lit(0)).alias("failed"), rate.alias("rate"), status.alias("status"))


def failing_rows(df: DataFrame, checks: list[Check], row_id: str = "_row_id") -> DataFrame:
    """(row_id, check_id) of each row that fails a row rule or shares a key that must be unique."""
    hits, out = [], df
    for k, c in enumerate(checks):
        within = scope(df, c.scope)
        if c.kind in ROW_KINDS:
            e, f = row_rule(c)
            hits.append(F.when(within & e & F.coalesce(f, F.lit(False)), F.lit(c.id)))
        else:
            keys = list(c.args.get("columns", ())) or [c.column]
            full = reduce(lambda x, y: x & y, [F.col(x).isNotNull() for x in keys])
            again = df.where(within & full).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*[F.col(x).alias(f"__{k}_{x}") for x in keys], F.lit(True).alias(f"__{k}"))
            out = out.join(again, [out[x] == again[f"__{k}_{x}"] for x in keys], "left")
            hits.append(F.when(within & F.col(f"__{k}"), F.lit(c.id)))
    return out.select(F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*hits))).alias("check_id"))


def quarantined(df: DataFrame, checks: list[Check], row_id: str = "_row_id") -> tuple[DataFrame, DataFrame]:
    """(rows that no BLOCKER fails, exclusions): by severity of the check, whether or not it passes as a whole."""
    bad = failing_rows(df, [c for c in checks if c.severity == "BLOCKER"], row_id)
    return df.join(bad.select(F.col("row_id").alias(row_id)).distinct(), row_id, "left_anti"), bad
