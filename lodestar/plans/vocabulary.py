"""Words of questions: terms that name members or groups, relative periods, states with a meaning, caveats, the trace of an answer.

Driver-side and small but for the members, which are the distinct values of dimensions, read by Spark and bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import slug_of
from lodestar.plans.questions import Question, periods_between
from lodestar.specs import Metric

#: Members that a dimension may have to be read whole.
MOST_MEMBERS = 10_000


@dataclass(frozen=True)
class Meaning:
    """What a term stands for: members of one dimension, or a predicate on a boolean column."""

    dimension: str | None = None
    members: tuple[str, ...] = ()
    predicate: str | None = None


class Unresolved(ValueError):
    """A term that stands for nothing, for several things, or for what no question may ask."""


@dataclass
class Vocabulary:
    """Terms are equal to members, synonyms or groups by their slugs, never alike. Reserved terms stand for nothing."""

    members: dict[str, list[str]]
    synonyms: dict[str, tuple[str, str]] = field(default_factory=dict)
    groups: dict[str, Meaning] = field(default_factory=dict)
    reserved: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, dimensions: dict[str, tuple[DataFrame, str]], **more) -> Vocabulary:
        """The members of each dimension from its table and column; a dimension of more than MOST_MEMBERS is refused."""
        found = {}
        for name, (df, column) in dimensions.items():
            rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("m")).distinct().orderBy("m").limit(MOST_MEMBERS + 1).collect()
            if len(rows) > MOST_MEMBERS:
                raise ValueError(f"{name} has more than {MOST_MEMBERS} members")
            found[name] = [r["m"] for r in rows]
        return cls(found, **more)

    def resolve(self, term: str, dimension: str | None = None) -> Meaning:
        told = slug_of(term)
        for word, why in self.reserved.items():
            if slug_of(word) == told:
                raise Unresolved(f"{term!r} is reserved: {why}")
        for name, meaning in self.groups.items():
            if slug_of(name) == told and dimension in (None, meaning.dimension):
                return meaning
        named = [(d, m) for d, ms in self.members.items() for m in ms if slug_of(m) == told and dimension in (None, d)]
        named += [(d, m) for word, (d, m) in self.synonyms.items() if slug_of(word) == told and dimension in (None, d) and (d, m) not in named]
        if not named:
            raise Unresolved(f"{term!r} is no term" + (f" of {dimension}" if dimension else "") + "; nothing is matched by likeness")
        if len(named) > 1:
            raise Unresolved(f"{term!r} may be {' or '.join(f'{d}={m}' for d, m in named)}; name the dimension")
        return Meaning(named[0][0], (named[0][1],))

    def terms(self) -> dict[str, set]:
        return {d: set(ms) for d, ms in self.members.items()}

    def filters(self, terms: list[str]) -> tuple[dict[str, list[str]], list[str]]:
        """(members by dimension, predicates) that all hold; terms of one dimension are alternatives."""
        members: dict[str, list[str]] = {}
        predicates = []
        for term in terms:
            meaning = self.resolve(term)
            if meaning.predicate:
                predicates.append(meaning.predicate)
            if meaning.dimension:
                own = members.setdefault(meaning.dimension, [])
                own += [m for m in meaning.members if m not in own]
        return members, predicates


def condition(period: str, periods: tuple[str, str], members: dict[str, list[str]], predicates: list[str], exposed: list[str]) -> Column:
    """Rows of the periods, ends included, of the members and of every predicate; a column that is not exposed is an error."""
    if hidden := [c for c in (*members, *predicates) if c not in exposed]:
        raise Unresolved(f"not exposed: {', '.join(hidden)}")
    out = F.col(period).between(*periods)
    for d, values in members.items():
        out = out & F.col(d).isin(values)
    for p in predicates:
        out = out & F.coalesce(F.col(p), F.lit(False))
    return out


def relative_period(term: str, metric: Metric, grain: str) -> tuple[str, str]:
    """Periods before the end of the metric's coverage, never before today: "latest", "previous", "last N", "year to date"."""
    if metric.coverage is None:
        raise Unresolved(f"{metric.id} declares no coverage")
    last = _as_grain(metric.coverage[1], grain)
    told = slug_of(term)
    if told == "latest":
        return last, last
    if told == "previous":
        back = _back(last, 1)
        return back, back
    if m := re.fullmatch(r"last (\d+)", told):
        if int(m[1]) < 1:
            raise Unresolved("at least one period")
        return _back(last, int(m[1]) - 1), last
    if told == "year to date":
        first = last
        while _back(first, 1)[:4] == last[:4]:
            first = _back(first, 1)
        return first, last
    raise Unresolved(f"{term!r} is no relative period")


def _as_grain(month: str, grain: str) -> str:
    year, m = month[:4], int(month[5:7]) if re.fullmatch(r"\d{4}-\d{2}", month) else 12
    if not re.fullmatch(r"\d{4}-\d{2}", month) and grain != "year" and "-" in month:
        return month
    return {"month": f"{year}-{m:02d}", "quarter": f"{year}-Q{(m + 2) // 3}", "half": f"{year}-H{(m + 5) // 6}", "year": year}[grain]


def _back(period: str, n: int) -> str:
    from lodestar.functions.dates import previous_period

    for _ in range(n):
        period = previous_period(period)
    return period


#: Members that are states of the data and not values, with what they mean; pending ones wait for a decision.
STATES = {
    "UNMAPPED": ("PENDING", "the source value has no approved standard value"), "PENDING": ("PENDING", "the value waits for a decision"), "MISSING": ("STATE", "the source has no value"),
    "UNKNOWN": ("STATE", "no member has this key"), "UNDETERMINED": ("STATE", "no rule applies"),
}


def is_state(c: Column) -> Column:
    return F.coalesce(c.isin(*STATES), F.lit(False))


def is_pending(c: Column) -> Column:
    return F.coalesce(c.isin(*[s for s, (kind, _) in STATES.items() if kind == "PENDING"]), F.lit(False))


def coverage(q: Question, metric: Metric, rows: list[dict]) -> float:
    """The share of the periods asked for that have rows."""
    asked = periods_between(q.grain, q.start, q.end)
    return len({r["period"] for r in rows}) / asked if asked > 0 else 0.0


def caveats(q: Question, metric: Metric, rows: list[dict], pending: dict[str, str] | None = None) -> list[str]:
    """What a reader must know besides the numbers, in a fixed order."""
    share = coverage(q, metric, rows)
    out = [f"{share:.0%} of the periods have data"] if share < 1 else []
    for d in q.dimensions:
        states = sorted({r[d] for r in rows if r.get(d) in STATES})
        out += [f"{d}={s}: {STATES[s][1]}" for s in states]
    hidden = sum(r.get("suppression", "no") != "no" for r in rows)
    out += [f"{hidden} rows are withheld for groups under {metric.minimum_n}"] if hidden else []
    out += [f"{name}: {why}" for name, why in sorted((pending or {}).items()) if name not in metric.mappings]
    if metric.status != "CERTIFIED":
        out.append(f"{metric.id} is {metric.status.lower()}, not certified")
    return out


#: The steps that an answer went through, from what was asked to what was shown.
STEPS = ("question", "contract", "data", "checks", "privacy", "answer")


def trace(q: Question, metric: Metric, answer: dict, source: str, checks: list[str], at: str = "") -> list[dict]:
    """One entry for each of STEPS, without the rows answered."""
    rows = answer.get("rows", [])
    refusal = answer.get("refusal")
    told = {
        "question": {"metric": q.metric, "grain": q.grain, "period": (q.start, q.end), "dimensions": q.dimensions, "filters": dict(q.filters), "at": at},
        "contract": {"version": metric.version, "status": metric.status, "measure": metric.measure, "rollup": metric.rollup, "population": metric.population},
        "data": {"source": source, "coverage": metric.coverage, "rows": len(rows)},
        "checks": {"checks": sorted(checks), "trust": answer.get("trust")},
        "privacy": {"minimum_n": metric.minimum_n, "withheld": sum(r.get("suppression", "no") != "no" for r in rows)},
        "answer": {"outcome": answer["outcome"], "refusal": refusal.kind if refusal else None, "level": answer.get("level")},
    }
    return [{"step": k, "name": name, **told[name]} for k, name in enumerate(STEPS, 1)]
