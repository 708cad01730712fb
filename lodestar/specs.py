"""What the engine is told: frozen descriptions of sources, checks, metrics. No data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SourceSpec:
    system: str
    dataset: str
    format: str  # csv, parquet, json, xlsx
    options: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class InputSpec:
    """How a dataset's rows become normalised ones: (name, its column, or None where it has none) for each name."""

    system: str
    dataset: str
    id: str
    columns: tuple[tuple[str, str | None], ...]
    own_id: str | None = None  # the column of an entity id that the source itself carries
    row_id: str = "_row_id"


@dataclass(frozen=True)
class StandardSpec:
    """Roles of a dataset's columns: dates with their declared format, decimals, and free text to repair."""

    dates: dict = field(default_factory=dict)
    decimals: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    """One data-quality expectation; severity is BLOCKER, CRITICAL, WARNING or INFO."""

    id: str
    dataset: str
    kind: str
    column: str = ""
    severity: str = "CRITICAL"
    finding: str = "INVALID"
    most: float = 0.0  # the failure rate up to which it passes
    args: dict = field(default_factory=dict)
    scope: dict | None = None
    metrics: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.finding not in FINDINGS:
            raise ValueError(f"check {self.id}: no class of findings {self.finding!r}")


# Classes of findings with the component that each counts for, severities that count, and bands of trust.
#: Classes of findings; the component that each counts for.
COMPONENTS = {
    "validity": ("INVALID", "DIVERGENT"),
    "coverage": ("UNMAPPED", "DECISION_PENDING"),
    "identity": ("IDENTITY_UNRESOLVED",),
    "timeliness": ("STALE",),
}
#: What each class of findings says, and whether it waits for a decision or for data instead of being an error.
FINDINGS = {
    "INVALID": ("the value breaks a rule and is wrong", False),
    "UNMAPPED": ("a value that is legitimate at its source has no approved mapping", True),
    "DECISION_PENDING": ("a decision of the business is open; there is no technical answer", True),
    "IDENTITY_UNRESOLVED": ("the person exists, the link between systems was not made", True),
    "LEGITIMATELY_ABSENT": ("the field did not exist then, or leaving it out is the person's choice", True),
    "DIVERGENT": ("two sources disagree; neither need be wrong", False),
    "STALE": ("the data exists at its source and came late or not yet", True),
}
#: Reported, never counted against a metric.
LEGITIMATE = ("LEGITIMATELY_ABSENT",)
#: Severities that count.
WEIGHING = ("BLOCKER", "CRITICAL")
CERTIFIED, LIMITED, PENDING_FLOOR = 0.95, 0.70, 0.40


@dataclass(frozen=True)
class Metric:
    """A closed-form metric over a base view: there is no free expression."""

    id: str
    measure: str  # distinct, sum, median, ratio, distinct_ratio, turnover
    value: str = ""
    over: str = ""  # the denominator's column of a ratio
    population: str = "entity"
    dimensions: tuple[str, ...] = ()
    grain: str = "month"
    rollup: str | None = "sum"  # sum, last_period or None
    coverage: tuple[str, str] | None = None
    status: str = "CERTIFIED"  # DRAFT, DECLARED, CERTIFIED, BLOCKED
    version: str = "1.0.0"
    minimum_n: int = 5
    blockers: tuple[str, ...] = ()
    mappings: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()  # registered rules of interpretation, by their owners' names for them
    studies: tuple[str, ...] = ()  # registered causal studies
