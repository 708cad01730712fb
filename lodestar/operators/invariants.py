"""Invariants of a star schema that must hold without exception, or within sampling noise: a row of result for each.

Rules are data. Those over the same rows share a scan, those over keys of the whole star share one shuffle:

- ``Rule``: a condition on a row; all rules of a frame are one aggregate.
- ``Unique``, ``Known``, ``Disjoint``: keys that stand once, that another frame has, that no other frame has. Every frame is
  read once, its keys go out tagged with their rules, and one aggregate by (rule, key) decides all; keys are combined before
  they are shuffled, so a key of a third of the rows is a row for each task. A rule is a number and a key one text there.
- ``Within``: events inside a tenure of their entity. Events of all frames are counted by (entity, day) first, so an entity
  has at most a row a day, however many events it has, when it meets its tenures, which are one row.
- ``History``: versions of an entity, from one sort.
- ``Planned``, ``Falling``, ``Steady``, ``Rates``, ``Trend``, ``Reaching``: counts and shares against a plan or along ranks, with
  tolerances that follow the size of the sample.

Results: rule, severity, evaluated, violations, measure, allowed, passed. A null condition is no violation. A rule with
nothing to evaluate passes with 0 evaluated. A rule of a frame or column that is not there is an error.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKER, CRITICAL, WARNING = "BLOCKER", "CRITICAL", "WARNING"
_OUT = ("rule", "evaluated", "violations", "measure", "allowed")


@dataclass(frozen=True)
class Rule:
    """``broken`` (SQL) is never true where ``where`` is."""

    id: str
    frame: str
    broken: str
    where: str = "true"
    severity: str = BLOCKER


@dataclass(frozen=True)
class Exactly:
    """``n`` rows are as ``where`` says."""

    id: str
    frame: str
    where: str
    n: int = 1
    severity: str = BLOCKER


@dataclass(frozen=True)
class Unique:
    id: str
    frame: str
    columns: tuple[str, ...]
    severity: str = BLOCKER


@dataclass(frozen=True)
class Known:
    """Keys of ``columns`` (where all are set) are keys of the other frame."""

    id: str
    frame: str
    columns: tuple[str, ...]
    other: str
    others: tuple[str, ...]
    where: str = "true"
    severity: str = BLOCKER


@dataclass(frozen=True)
class Disjoint(Known):
    """Keys of ``columns`` (where ``where``) are not among the other frame's."""


@dataclass(frozen=True)
class Within:
    """Each event's ``date`` is inside a tenure of its entity, both ends included; an open end is null."""

    id: str
    frame: str
    entity: str
    date: str
    tenures: str
    of: tuple[str, str, str]  # entity, from, to
    severity: str = BLOCKER


@dataclass(frozen=True)
class History:
    """Of each entity's versions: one is current, none overlap, none leave a gap, the first begins at ``begin``.

    Gives four rows, ``id`` with .current, .overlap, .gap and .begin."""

    id: str
    frame: str
    entity: str
    since: str
    to: str
    current: str
    begin: str
    severity: str = BLOCKER


@dataclass(frozen=True)
class Planned:
    """Rows of each period are as many as the plan's target, within max(tolerance, 3 / sqrt(target)); ``id``.total: all
    together within the tolerance."""

    id: str
    frame: str
    period: str
    plan: str
    of: tuple[str, str]  # period, target
    tolerance: float
    severity: str = CRITICAL


@dataclass(frozen=True)
class Falling:
    """The share of ``flag`` does not rise from a band of ``by`` to the next."""

    id: str
    frame: str
    by: str
    bands: tuple[tuple, ...]
    flag: str
    where: str = "true"
    severity: str = CRITICAL


@dataclass(frozen=True)
class Steady:
    """Between neighbours among the values of ``by``, in order, that have ``least`` rows, the share never rises by more than ``rise``."""

    id: str
    frame: str
    by: str
    order: tuple
    flag: str
    least: int = 200
    rise: float = 0.08
    severity: str = CRITICAL


@dataclass(frozen=True)
class Rates:
    """The rate of ``flag`` in each group of ``least`` rows is its target, within max(tolerance, noise / sqrt(rows))."""

    id: str
    frame: str
    by: str
    targets: dict = field(hash=False)
    flag: str = "false"
    where: str = "true"
    least: int = 30
    tolerance: float = 0.06
    noise: float = 2.5
    severity: str = CRITICAL


@dataclass(frozen=True)
class Trend:
    """The yearly share of ``flag`` does not fall by ``fall`` or more from its first three years to its last three; with
    fewer than four years, from the first to the last. Years of fewer than ``least`` rows don't count."""

    id: str
    frame: str
    year: str
    flag: str
    where: str = "true"
    least: int = 30
    fall: float = 0.01
    severity: str = WARNING


@dataclass(frozen=True)
class Reaching:
    """Every value of ``by`` that rows have is also had by a row as ``where`` says."""

    id: str
    frame: str
    by: str
    where: str
    severity: str = BLOCKER


def _row(df: DataFrame, rule: str, evaluated: Column, violations: Column, measure: Column | None = None, allowed: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(F.lit(rule).alias("rule"), F.coalesce(evaluated, F.lit(0)).cast("bigint").alias("evaluated"), F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"), (none if measure is None else measure).cast("double").alias("measure"), (none if allowed is None else allowed).cast("double").alias("allowed"))


def _yes(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def _rows(rules: list, df: DataFrame) -> DataFrame:
    """All conditions of a frame in one aggregate."""
    named = []
    for r in rules:
        if isinstance(r, Exactly):
            n = F.count_if(_yes(r.where))
            parts = n, F.abs(n - r.n)
        else:
            parts = F.count_if(_yes(r.where)), F.count_if(_yes(r.where) & _yes(r.broken))
        named.append(F.struct(F.lit(r.id).alias("rule"), *[p.cast("bigint").alias(n) for n, p in zip(("evaluated", "violations"), parts, strict=True)]))
    got = df.agg(F.array(*named).alias("r")).select(F.explode("r").alias("r"))
    none = F.lit(None).cast("double")
    return got.select("r.*", none.alias("measure"), none.alias("allowed"))


def _tagged(rules: list, frames: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, left, right) of the keys of all rules, each frame read once: the rule's place and the key as one text.

    Parts of a key of several columns follow their lengths, so unlike keys have unlike texts.
    """
    tagged = defaultdict(list)
    for k, r in enumerate(rules):
        tagged[r.frame].append((k, "left", r.columns, getattr(r, "where", "true")))
        if isinstance(r, Known):
            tagged[r.other].append((k, "right", r.others, "true"))
    parts = []
    for frame, uses in tagged.items():
        each = []
        for rule, side, columns, where in uses:
            full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]) & _yes(where)
            texts = [F.col(c).cast("string") for c in columns]
            key = texts[0] if len(texts) == 1 else F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])
            each.append(F.when(full, F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.lit(side == "left").cast("bigint").alias("left"), F.lit(side == "right").cast("bigint").alias("right"))))
        parts.append(frames[frame].select(F.explode(F.array_compact(F.array(*each))).alias("k")).select("k.*"))
    return reduce(DataFrame.unionByName, parts)


def _keys(rules: list, frames: dict[str, DataFrame]) -> DataFrame:
    """Keys of all rules, each frame read once, decided by one aggregate."""
    counted = _tagged(rules, frames).groupBy("rule", "key").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    kind = F.element_at(F.array(*[F.lit(type(r).__name__) for r in rules]), F.col("rule") + 1)
    bad = F.when(kind == "Unique", F.col("left") > 1).when(kind == "Known", (F.col("left") > 0) & (F.col("right") == 0)).otherwise((F.col("left") > 0) & (F.col("right") > 0))
    found = counted.groupBy(F.col("rule").alias("k")).agg(F.sum("left").alias("evaluated"), F.count_if(bad).alias("violations"))
    every = frames[rules[0].frame].sparkSession.createDataFrame([(k, r.id) for k, r in enumerate(rules)], "k int, rule string")  # an empty frame has no keys
    none = F.lit(None).cast("double")
    return every.join(F.broadcast(found), "k", "left").select("rule", F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("violations", F.lit(0)).alias("violations"), none.alias("measure"), none.alias("allowed"))


def _within(rules: list[Within], frames: dict[str, DataFrame]) -> DataFrame:
    """Events of all rules that look at the same tenures: an entity's days with their events meet its tenures, a row of them."""
    first = rules[0]
    entity, since, to = first.of
    sides = [f"n{k}" for k in range(len(rules))]
    events = [frames[r.frame].select(F.col(r.entity).cast("string").alias("entity"), F.to_date(r.date).alias("day"), *[F.lit(int(j == k)).cast("bigint").alias(n) for j, n in enumerate(sides)]) for k, r in enumerate(rules)]
    counted = reduce(DataFrame.unionByName, events).where("entity IS NOT NULL AND day IS NOT NULL").groupBy("entity", "day").agg(*[F.sum(n).alias(n) for n in sides])
    tenures = frames[first.tenures].select(F.col(entity).cast("string").alias("entity"), F.struct(F.to_date(since).alias("since"), F.to_date(to).alias("to")).alias("t"))
    tenures = tenures.where("entity IS NOT NULL").groupBy("entity").agg(F.collect_set("t").alias("tenures"))
    inside = F.exists("tenures", lambda t: F.coalesce((F.col("day") >= t["since"]) & (t["to"].isNull() | (F.col("day") <= t["to"])), F.lit(False)))
    each = [F.struct(F.lit(r.id).alias("rule"), F.coalesce(F.sum(n), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col(n))), F.lit(0)).alias("violations")) for n, r in zip(sides, rules, strict=True)]
    none = F.lit(None).cast("double")
    met = counted.join(tenures, "entity").select(inside.alias("inside"), *sides)
    return met.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*", none.alias("measure"), none.alias("allowed"))


def _history(r: History, df: DataFrame) -> DataFrame:
    order = W.partitionBy("e").orderBy("s", "t")
    v = df.select(F.col(r.entity).alias("e"), F.to_date(r.since).alias("s"), F.to_date(r.to).alias("t"), F.col(r.current).alias("c"), F.to_date(r.begin).alias("b")).where("e IS NOT NULL")
    v = v.withColumn("next", F.lead("s").over(order)).withColumn("k", F.row_number().over(order))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    each = v.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("current"), yes(F.col("t") >= F.col("next")).alias("overlap"), yes(F.datediff("next", "t") != 1).alias("gap"), yes((F.col("k") == 1) & (F.col("s") != F.col("b"))).alias("begin"))
    total = each.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"), F.count_if(F.col("current") != 1).alias("current"), *[F.sum(c).alias(c) for c in ("overlap", "gap", "begin")])
    of = {"current": "entities", "overlap": "rows", "gap": "rows", "begin": "entities"}
    rows = [F.struct(F.lit(f"{r.id}.{c}").alias("rule"), F.coalesce(n, F.lit(0)).alias("evaluated"), F.coalesce(c, F.lit(0)).alias("violations")) for c, n in of.items()]
    none = F.lit(None).cast("double")
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*", none.alias("measure"), none.alias("allowed"))


def _planned(r: Planned, frames: dict[str, DataFrame]) -> DataFrame:
    real = frames[r.frame].groupBy(F.col(r.period).alias("p")).agg(F.count(F.lit(1)).alias("got"))
    plan = frames[r.plan].select(F.col(r.of[0]).alias("p"), F.col(r.of[1]).cast("double").alias("target"))
    both = plan.join(real, "p", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    off = F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))
    allowed = F.greatest(F.lit(r.tolerance), 3.0 / F.greatest(F.lit(1.0), F.sqrt("target")))
    worst = both.select("got", "target", off.alias("off"), allowed.alias("most")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") > F.col("most")).alias("bad"), F.max(F.struct((F.col("off") - F.col("most")).alias("by"), "off", "most")).alias("w"), F.sum("got").alias("got"), F.sum("target").alias("target")
    )
    whole = F.try_divide(F.abs(F.col("got") - F.col("target")), F.col("target"))
    return _row(worst, r.id, F.col("n"), F.col("bad"), F.round("w.off", 6), F.round("w.most", 6)).unionByName(_row(worst, f"{r.id}.total", F.col("n"), (whole > r.tolerance).cast("bigint"), F.round(whole, 6), F.lit(r.tolerance)))


def _shares(df: DataFrame, groups: list[Column], flag: str) -> DataFrame:
    """An array of (n, share) in the order of the groups, from one aggregate."""
    yes = _yes(flag)
    return df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.count_if(g).alias("n"), F.coalesce(F.try_divide(F.count_if(g & yes), F.count_if(g)), F.lit(0.0)).alias("share")) for g in groups]).alias("s"))


def _rises(s: Column, beyond: float) -> Column:
    """Array of the rises from a share to the next that are more than ``beyond``."""
    steps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b["share"] - a["share"])
    return F.filter(steps, lambda x: x > beyond), F.array_max(steps)


def _gradient(r: Falling | Steady, df: DataFrame) -> DataFrame:
    c = F.col(r.by)
    if isinstance(r, Falling):
        s = _shares(df.where(_yes(r.where)), [F.coalesce(c.isin(*band), F.lit(False)) for band in r.bands], r.flag)
        kept, beyond = F.col("s"), 0.0
    else:
        s = _shares(df, [F.coalesce(c == v, F.lit(False)) for v in r.order], r.flag)
        kept, beyond = F.filter("s", lambda x: x["n"] >= r.least), r.rise
    bad, most = _rises(kept, beyond)
    return _row(s, r.id, F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]), F.size(bad), F.round(most, 6), F.lit(beyond))


def _rates(r: Rates, df: DataFrame) -> DataFrame:
    target = F.create_map(*[F.lit(x) for kv in r.targets.items() for x in kv])[F.col(r.by)]
    each = df.where(_yes(r.where)).groupBy(r.by).agg(F.count(F.lit(1)).alias("n"), F.count_if(_yes(r.flag)).alias("hits")).withColumn("target", target.cast("double")).where((F.col("n") >= r.least) & F.col("target").isNotNull())
    off, allowed = F.abs(F.col("hits") / F.col("n") - F.col("target")), F.greatest(F.lit(r.tolerance), F.lit(r.noise) / F.sqrt("n"))
    got = each.select("n", off.alias("off"), allowed.alias("most")).agg(F.sum("n").alias("n"), F.count_if(F.col("off") > F.col("most")).alias("bad"), F.max(F.struct((F.col("off") - F.col("most")).alias("by"), "off", "most")).alias("w"))
    return _row(got, r.id, F.col("n"), F.col("bad"), F.round("w.off", 6), F.round("w.most", 6))


def _trend(r: Trend, df: DataFrame) -> DataFrame:
    years = df.where(_yes(r.where)).groupBy(F.col(r.year).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_if(_yes(r.flag)).alias("hits")).where((F.col("n") >= r.least) & F.col("y").isNotNull())
    got = years.agg(F.sum("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("y", (F.col("hits") / F.col("n")).alias("share")))), lambda x: x["share"]).alias("s"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / 3
    size = F.size("s")
    ends = F.when(size >= 4, mean(F.slice("s", -3, 3)) - mean(F.slice("s", 1, 3))).when(size >= 2, F.element_at("s", -1) - F.element_at("s", 1)).otherwise(0.0)
    return _row(got, r.id, F.col("n"), (ends <= -r.fall).cast("bigint"), F.round(ends, 6), F.lit(-r.fall))


def _reaching(r: Reaching, df: DataFrame) -> DataFrame:
    each = df.where(F.col(r.by).isNotNull()).groupBy(r.by).agg(F.count_if(_yes(r.where)).alias("n"))
    return _row(each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 0).alias("bad")), r.id, F.col("n"), F.col("bad"))


def checked(rules: list, frames: dict[str, DataFrame]) -> DataFrame:
    """A row for each rule (four for a History, two for a Planned)."""
    parts, rows, keys, events = [], defaultdict(list), [], defaultdict(list)
    for r in rules:
        if isinstance(r, Rule | Exactly):
            rows[r.frame].append(r)
        elif isinstance(r, Unique | Known):
            keys.append(r)
        elif isinstance(r, Within):
            events[r.tenures, r.of].append(r)
        elif isinstance(r, History):
            parts.append(_history(r, frames[r.frame]))
        elif isinstance(r, Planned):
            parts.append(_planned(r, frames))
        else:
            build = {Falling: _gradient, Steady: _gradient, Rates: _rates, Trend: _trend, Reaching: _reaching}[type(r)]
            parts.append(build(r, frames[r.frame]))
    parts += [_rows(own, frames[frame]) for frame, own in rows.items()]
    parts += [_keys(keys, frames)] if keys else []
    parts += [_within(own, frames) for own in events.values()]
    severity = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.severity)])
    of = F.coalesce(severity[F.col("rule")], severity[F.regexp_replace("rule", r"\.(current|overlap|gap|begin|total)$", "")])
    got = reduce(DataFrame.unionByName, [p.select(*_OUT) for p in parts])
    return got.select("rule", of.alias("severity"), "evaluated", "violations", "measure", "allowed", (F.col("violations") == 0).alias("passed"))


def blocking(results: DataFrame) -> DataFrame:
    """Failures that stop a run; a warning does not."""
    return results.where(~F.col("passed") & F.col("severity").isin(BLOCKER, CRITICAL))


def in_scale(value: str, date: str, scales: list[tuple[str, str | None, tuple[str, ...]]]) -> str:
    """SQL: the value is one of the scale's that is valid at the date; scales are (from, to or None, values)."""
    each = [f"({date} >= DATE '{a}'" + (f" AND {date} <= DATE '{b}'" if b else "") + f" AND {value} IN ({', '.join(repr(v) for v in values)}))" for a, b, values in scales]
    return " OR ".join(each)


def rank_of(column: str, ranks: list[str]) -> str:
    """SQL: the place of a value in a list, null for others."""
    return f"nullif(array_position(array({', '.join(repr(r) for r in ranks)}), {column}), 0)"


def workforce_rules(*, end: str, ranks: list[str], bands: tuple[tuple, ...], leads: tuple[str, ...], scales: list, learning_from: str, unit: tuple[str, str], declared_from: str, declared_values: tuple[str, ...], undeclared: dict[str, float], ages: dict[str, tuple[int, int]], tolerance: float = 0.05) -> list:
    """The laws of a workforce's star: histories, tenures, keys, events, scales, a plan, and shares along the hierarchy.

    Frames: entity (all versions), person (current versions), snapshot, exit, movement, compensation, performance, learning,
    engagement, requisition, application, organization, plan.
    """
    of = ("entity_id", "entry_date", "exit_date")
    dated = (("snapshot", "snapshot_date"), ("movement", "movement_date"), ("compensation", "effective_date"), ("performance", "review_date"), ("learning", "enrolment_date"), ("engagement", "survey_date"))
    old, new = rank_of("old_level", ranks), rank_of("new_level", ranks)
    age = " OR ".join(f"(entry_group = '{g}' AND year(entry_date) - birth_year NOT BETWEEN {lo - 1} AND {hi + 1})" for g, (lo, hi) in ages.items())
    values = ", ".join(repr(v) for v in declared_values)
    return [
        History("V01", "entity", "entity_id", "effective_from", "effective_to", "is_current", "entry_date"),
        Rule("V05", "entity", "exit_date < entry_date"),
        Rule("V06", "entity", f"entry_date > DATE '{end}'"),
        Known("V07", "entity", ("superior_id",), "entity", ("entity_id",)),
        Exactly("V09", "person", "superior_id IS NULL AND active"),
        *[Within(f"V15.{frame}", frame, "entity_id", date, "person", of) for frame, date in dated],
        Unique("V12", "snapshot", ("entity_id", "snapshot_date")),
        *[Known(f"V13.{frame}", frame, ("entity_id",), "entity", ("entity_id",)) for frame in ("exit", "movement", "compensation", "performance", "learning", "engagement")],
        Known("V14", "snapshot", ("org_key",), "organization", ("org_key",)),
        *[Unique(f"V16.{frame}", frame, keys) for frame, keys in (("exit", ("exit_id",)), ("movement", ("movement_id",)), ("requisition", ("requisition_id",)), ("application", ("requisition_id", "candidate_id")), ("entity", ("entity_key",)), ("organization", ("org_key",)))],
        Rule("V17", "movement", f"{new} <= {old}", "movement_type = 'Promotion'"),
        Rule("V18", "movement", f"{new} >= {old}", "movement_type = 'Demotion'"),
        Rule("V19", "engagement", "score IS NOT NULL", "NOT responded"),
        Rule("V20", "engagement", "score IS NULL", "responded"),
        Rule("V21", "performance", f"NOT coalesce({in_scale('rating', 'review_date', scales)}, false)"),
        Rule("V22", "learning", f"enrolment_date < DATE '{learning_from}'"),
        Rule("V23", "snapshot", f"snapshot_date < DATE '{unit[1]}'", f"business_unit = '{unit[0]}'"),
        Rule("V24", "compensation", "coalesce(base_salary, 0) <= 0"),
        Rule("V25", "application", "NOT coalesce(offer_accepted, false)", "hire_date IS NOT NULL"),
        Rule("V26", "requisition", "hire_date IS NULL", "status = 'Filled'"),
        Rule("V27", "requisition", "hire_date < opening_date", "hire_date IS NOT NULL"),
        Planned("V28", "snapshot", "snapshot_date", "plan", ("period", "target"), tolerance),
        Disjoint("V29", "person", ("entity_id",), "application", ("entity_id",), "origin LIKE 'acquisition%'"),
        Falling("V30", "person", "level_group", bands, "gender = 'Female'"),
        Steady("V30b", "person", "level_group", tuple(g for band in bands for g in band), "gender = 'Female'"),
        Falling("V31", "person", "level_group", bands, "ethnicity IN ('Preta', 'Parda')", "country = 'BR' AND declared"),
        Rates("V32", "person", "country", undeclared, "NOT declared", f"entry_date >= DATE '{declared_from}'"),
        Rule("V33", "entity", f"ethnicity IN ({values})", "NOT declared"),
        Rule("V34", "entity", f"declared_at < DATE '{declared_from}'"),
        Trend("V35", "snapshot", "year", "gender = 'Female'", f"level_group IN ({', '.join(repr(g) for g in leads)}) AND year >= 2021"),
        Rule("V36", "person", age),
        Reaching("V37", "person", "gender", f"level_group IN ({', '.join(repr(g) for g in leads)})"),
    ]
