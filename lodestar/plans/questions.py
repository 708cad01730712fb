"""Questions about metrics: their closed shape, the checks before any data is read, and what may be answered.

Driver-side and small: a question is a handful of names, an answer a handful of rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dates import previous_period
from lodestar.plans import metrics
from lodestar.specs import Metric

SHAPES = {"month": r"\d{4}-(0[1-9]|1[0-2])", "quarter": r"\d{4}-Q[1-4]", "half": r"\d{4}-H[12]", "year": r"\d{4}"}
LEVELS = ("FACT", "CONTEXT", "INTERPRETATION", "CAUSALITY")
COMPARISONS = ("previous_period", "same_period_last_year", "declared_period")
REFUSALS = (
    "UNKNOWN_METRIC", "METRIC_BLOCKED", "METRIC_IN_DRAFT", "UNKNOWN_VERSION", "DIMENSION_NOT_ALLOWED", "UNKNOWN_TERM", "PERIOD_OUT_OF_COVERAGE", "GRAIN_INCOMPATIBLE", "MAPPING_PENDING", "LEVEL_WITHOUT_EVIDENCE",
    "COMPARISON_NOT_POSSIBLE", "NO_DATA_IN_PERIOD", "TOO_MANY_PERIODS", "TOO_MANY_DIMENSIONS", "TOO_MANY_ROWS", "PRIVACY_NARROWING",
)
# Limits beyond which a question is refused, never cut.
MOST_PERIODS, MOST_DIMENSIONS, MOST_ROWS, MOST_EVALUATED = 24, 2, 50, 200


class QuestionShapeError(ValueError):
    """A question with a field that does not exist or has the wrong type: a mistake of the caller, not a refusal."""


@dataclass(frozen=True)
class Question:
    metric: str
    grain: str
    start: str
    end: str
    dimensions: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    compare: str | None = None
    compare_period: tuple[str, str] | None = None
    level: str = "FACT"
    version: str | None = None

    @classmethod
    def parse(cls, given: dict) -> Question:
        known = set(cls.__dataclass_fields__)
        if extra := set(given) - known:
            raise QuestionShapeError(f"no such field: {', '.join(sorted(extra))}")
        if missing := {"metric", "grain", "start", "end"} - set(given):
            raise QuestionShapeError(f"missing: {', '.join(sorted(missing))}")
        if given["grain"] not in SHAPES:
            raise QuestionShapeError(f"no grain {given['grain']!r}")
        if given.get("level", "FACT") not in LEVELS:
            raise QuestionShapeError(f"no level {given['level']!r}")
        return cls(**given | {"dimensions": tuple(given.get("dimensions", ()))})


@dataclass(frozen=True)
class Refusal:
    """Why there is no answer, and what would change that."""

    kind: str
    reason: str
    remedy: str


def _end_month(period: str) -> str:
    year, _, part = period.partition("-")
    if not part:
        return f"{year}-12"
    return f"{year}-{int(part[1]) * (3 if part[0] == 'Q' else 6):02d}" if part[0] in "QH" else period


def _start_month(period: str) -> str:
    year, _, part = period.partition("-")
    if not part:
        return f"{year}-01"
    return f"{year}-{(int(part[1]) - 1) * (3 if part[0] == 'Q' else 6) + 1:02d}" if part[0] in "QH" else period


def periods_between(grain: str, start: str, end: str) -> int:
    months = lambda m: int(m[:4]) * 12 + int(m[5:7])
    return (months(_end_month(end)) - months(_start_month(start))) // {"month": 1, "quarter": 3, "half": 6, "year": 12}[grain] + 1


def ceiling(m: Metric) -> str | None:
    """The highest level that a metric can be told at; None for one that is blocked or a draft.

    A certified one needs a registered study for CAUSALITY and a registered rule for INTERPRETATION; others end at CONTEXT.
    """
    if m.status in ("BLOCKED", "DRAFT"):
        return None
    if m.status != "CERTIFIED":
        return "CONTEXT"
    return "CAUSALITY" if m.studies else "INTERPRETATION" if m.rules else "CONTEXT"


def effective_level(asked: str, m: Metric, trust: str | None) -> tuple[str | None, str | None]:
    """(level, why it is lower than asked): the least of what is asked, the metric's ceiling and what the data's trust allows.

    No level is told of data that is BLOCKED or UNDETERMINED; LIMITED data ends at CONTEXT. Without a ledger of trust
    (None) the ceiling alone counts.
    """
    top = ceiling(m)
    if top is None:
        return None, f"{m.id} is {m.status}"
    if trust in ("BLOCKED", "UNDETERMINED"):
        return None, f"the data's trust is {trust}"
    why = f"the ceiling of {m.id} is {top}"
    if trust == "LIMITED" and LEVELS.index(top) > LEVELS.index("CONTEXT"):
        top, why = "CONTEXT", "trust LIMITED allows no interpretation"
    return (asked, None) if LEVELS.index(asked) <= LEVELS.index(top) else (top, why)


def validate(q: Question, catalog: dict[str, Metric], terms: dict[str, set], pending: dict[str, str] | None = None) -> Refusal | None:
    """The first of the checks that fails, in a fixed order; None if the question can be answered."""
    m = catalog.get(q.metric)
    if m is None:
        return Refusal("UNKNOWN_METRIC", f"there is no metric {q.metric!r}", f"ask for one of {', '.join(sorted(catalog))}")
    if m.status == "BLOCKED":
        return Refusal("METRIC_BLOCKED", f"{m.id} is blocked: {'; '.join(m.blockers) or 'no reason declared'}", "resolve what blocks it")
    if m.status == "DRAFT":
        return Refusal("METRIC_IN_DRAFT", f"{m.id} is not declared yet", "declare its owner, definition, grain and population")
    if q.version and q.version != m.version:
        return Refusal("UNKNOWN_VERSION", f"{m.id} has version {m.version}, not {q.version}", "ask for a registered version")
    for d in (*q.dimensions, *q.filters):
        if d not in m.dimensions:
            return Refusal("DIMENSION_NOT_ALLOWED", f"{m.id} does not answer by {d!r}", f"use one of {', '.join(m.dimensions)}")
    if len(q.dimensions) > MOST_DIMENSIONS:
        return Refusal("TOO_MANY_DIMENSIONS", f"{len(q.dimensions)} dimensions", f"use at most {MOST_DIMENSIONS}")
    for d, values in q.filters.items():
        for v in values:
            if v not in terms.get(d, set()):
                return Refusal("UNKNOWN_TERM", f"{v!r} is no term of {d}", "use a declared term; nothing is matched by likeness")
    if m.coverage is None:
        return Refusal("PERIOD_OUT_OF_COVERAGE", f"{m.id} declares no coverage", "declare it")
    for p in (q.start, q.end):
        if not re.fullmatch(SHAPES[q.grain], p):
            return Refusal("GRAIN_INCOMPATIBLE", f"{p!r} is no {q.grain}", f"write it as {SHAPES[q.grain]}")
    first, last = _start_month(m.coverage[0]), _end_month(m.coverage[1])
    if not (first[:4] <= _start_month(q.start)[:4] and _end_month(q.start) >= first and _start_month(q.end) <= last and q.start <= q.end):
        return Refusal("PERIOD_OUT_OF_COVERAGE", f"{m.id} has data from {m.coverage[0]} to {m.coverage[1]}; zero would be wrong", "ask within the coverage")
    if periods_between(q.grain, q.start, q.end) > MOST_PERIODS:
        return Refusal("TOO_MANY_PERIODS", "the range is too long", f"ask for at most {MOST_PERIODS} periods")
    if q.grain != m.grain and (metrics.FINENESS[q.grain] < metrics.FINENESS[m.grain] or not m.rollup):
        return Refusal("GRAIN_INCOMPATIBLE", f"{m.id} is told by {m.grain}", f"ask by {m.grain}" + ("" if m.rollup else " or declare how it rolls up"))
    for name in m.mappings:
        if name in (pending or {}):
            return Refusal("MAPPING_PENDING", f"{m.id} depends on {name}: {pending[name]}", "decide the open exceptions")
    top = ceiling(m)
    if LEVELS.index(q.level) > LEVELS.index(top):
        return Refusal("LEVEL_WITHOUT_EVIDENCE", f"{q.level} is not supported for {m.id}: the ceiling is {top}", "register the evidence that the level needs")
    if (q.compare == "declared_period") != (q.compare_period is not None) or (q.compare and q.compare not in COMPARISONS):
        return Refusal("COMPARISON_NOT_POSSIBLE", f"basis {q.compare!r} with period {q.compare_period!r}", f"use one of {', '.join(COMPARISONS)}; only a declared period has a period")
    return None


def ask(q: Question, catalog: dict[str, Metric], base: DataFrame, terms: dict[str, set], trust: dict | None = None, pending: dict[str, str] | None = None) -> dict:
    """The answer's envelope: outcome ANSWER, SUPPRESSED or REFUSAL. At most MOST_EVALUATED rows come to the driver."""
    if refused := validate(q, catalog, terms, pending):
        return {"outcome": "REFUSAL", "refusal": refused}
    m = catalog[q.metric]
    result = metrics.evaluated(m, base, q.grain, (q.start, q.end), q.dimensions, q.filters)
    safe = metrics.protected(result, m.minimum_n, ["period"] if q.dimensions else [], list(q.dimensions) or ["period"])
    if not q.dimensions:  # nothing to subtract from: each period stands alone
        small = F.col("population") < m.minimum_n
        safe = result.withColumn("suppression", F.when(small, "primary").otherwise("no")).withColumns({c: F.when(~small, F.col(c)) for c in ("value", "population")})
    rows = [r.asDict() for r in safe.orderBy("period", *q.dimensions).limit(MOST_EVALUATED + 1).collect()]
    if not rows:
        return {"outcome": "REFUSAL", "refusal": Refusal("NO_DATA_IN_PERIOD", "nothing was observed, which is not zero", "ask for a period with data")}
    if len(rows) > MOST_EVALUATED:
        return {"outcome": "REFUSAL", "refusal": Refusal("TOO_MANY_ROWS", f"more than {MOST_EVALUATED} rows", "filter, or drop a dimension")}
    shown = [r for r in rows if r["suppression"] == "no"]
    if not shown:
        return {"outcome": "SUPPRESSED", "rows": [], "minimum_n": m.minimum_n}
    told = certified(m, q, trust or {}, len({r["period"] for r in rows}) / periods_between(q.grain, q.start, q.end))
    level, why = effective_level(q.level, m, None if trust is None else told)
    if level is None:
        return {"outcome": "REFUSAL", "refusal": Refusal("LEVEL_WITHOUT_EVIDENCE", f"{m.id} is told at no level in this cut: {why}", "resolve what lowers the trust")}
    answer = {"outcome": "ANSWER", "rows": rows, "value": shown[0]["value"] if len(rows) == 1 else None, "trust": told, "level": level, "lowered": why}
    if q.compare:
        answer["comparison"] = _comparison(q, catalog, base, terms, answer)
        if level == "CONTEXT" and not answer["comparison"]["possible"]:
            answer |= {"level": "FACT", "lowered": "the basis of the comparison has no answer"}
    return answer


def _comparison(q: Question, catalog: dict, base: DataFrame, terms: dict, answer: dict) -> dict:
    if q.compare == "declared_period":
        start, end = q.compare_period
    else:
        back = {"years": 1} if q.compare == "same_period_last_year" else {}
        start, end = previous_period(q.start, **back), previous_period(q.end, **back)
    other = ask(Question(q.metric, q.grain, start, end, q.dimensions, q.filters), catalog, base, terms)
    if other["outcome"] != "ANSWER" or answer["value"] is None or other["value"] is None:
        return {"possible": False, "period": (start, end)}
    delta = answer["value"] - other["value"]
    return {"possible": True, "period": (start, end), "base": other["value"], "delta": delta, "relative": delta / other["value"] if other["value"] else None, "direction": "UP" if delta > 0 else "DOWN" if delta < 0 else "STABLE", "statement": "association"}


ORDER = ("BLOCKED", "UNDETERMINED", "LIMITED", "CERTIFIED")


def certified(m: Metric, q: Question, trust: dict, share: float = 1.0) -> str:
    """The least of the data's trust in the question's cut, what the metric's own status allows, and LIMITED if only a
    share of the periods asked for has data."""
    cut = next((f"{d}={v[0]}" for d, v in q.filters.items() if len(v) == 1 and (m.id, f"{d}={v[0]}") in trust), "ALL")
    data = trust.get((m.id, cut), "UNDETERMINED")
    ceiling = {"CERTIFIED": "CERTIFIED", "DECLARED": "LIMITED"}.get(m.status, "BLOCKED")
    return min(data, ceiling, "CERTIFIED" if share >= 1 else "LIMITED", key=ORDER.index)


def changed_version(old: Metric, new: Metric) -> str:
    """The next version: major for another meaning, minor for another reach, patch for the rest."""
    major, minor, patch = map(int, old.version.split("."))
    if any(getattr(old, f) != getattr(new, f) for f in ("measure", "value", "over", "population", "grain", "rollup")):
        return f"{major + 1}.0.0"
    if any(getattr(old, f) != getattr(new, f) for f in ("dimensions", "coverage", "minimum_n", "status")):
        return f"{major}.{minor + 1}.0"
    return f"{major}.{minor}.{patch + 1}" if old != new else old.version


class PrivacyGuard:
    """After a suppression, only broader questions on the same metric and period: fewer filters and no breakdown."""

    def __init__(self) -> None:
        self.suppressed: list[Question] = []

    def note(self, q: Question, answer: dict) -> None:
        """Whole suppressions, and breakdowns of which some rows are withheld."""
        if answer["outcome"] == "SUPPRESSED" or any(r.get("suppression", "no") != "no" for r in answer.get("rows", [])):
            self.suppressed.append(q)

    def allows(self, q: Question) -> bool:
        return all(
            not q.dimensions and q.filters.items() < s.filters.items() if (q.metric, q.start, q.end) == (s.metric, s.start, s.end) and q != s else True for s in self.suppressed
        )


@dataclass(frozen=True)
class Actor:
    """Who asks: scopes, dimensions denied, metrics allowed (all if None), and the highest level."""

    scopes: frozenset = frozenset()
    denied: frozenset = frozenset()
    metrics: frozenset | None = None
    level: str = "FACT"

    def refused(self, capability: str, q: Question) -> str | None:
        if capability not in self.scopes:
            return "SCOPE"
        if self.metrics is not None and q.metric not in self.metrics:
            return "METRIC"
        if self.denied & {*q.dimensions, *q.filters}:
            return "DIMENSION"
        return "LEVEL" if LEVELS.index(q.level) > LEVELS.index(self.level) else None
