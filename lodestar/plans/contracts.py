"""Which checks feed which metric, seed mappings, the log of questions, and the envelopes of the tools over them."""

from __future__ import annotations

import csv
import json
import sqlite3
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodestar.plans.questions import Actor, PrivacyGuard, Question, QuestionShapeError, ask
from lodestar.specs import Check, Metric


def derived(checks: list[Check]) -> dict[str, list[str]]:
    """The checks of each metric, from what each check says that it feeds."""
    out: dict[str, list[str]] = {}
    for c in checks:
        for m in c.metrics:
            out.setdefault(m, []).append(c.id)
    return {m: sorted(ids) for m, ids in out.items()}


def inconsistencies(checks: list[Check], catalog: dict[str, Metric], declared: dict[str, list[str]]) -> list[str]:
    """Checks that feed nothing, metrics that do not exist, and contracts out of step with the checks."""
    ids, want = {c.id for c in checks}, derived(checks)
    out = [f"check {c.id} feeds no metric" for c in checks if not c.metrics]
    out += [f"checks feed {m}, which has no contract" for m in want if m not in catalog]
    for m, given in declared.items():
        out += [f"{m} depends on {c}, which does not exist" for c in given if c not in ids]
        if sorted(given) != want.get(m, []):
            out.append(f"{m}: missing {sorted(set(want.get(m, [])) - set(given))}, extra {sorted(set(given) - set(want.get(m, [])))}")
    return out


def write_mapping(path: str, field_name: str, pairs: list[tuple[str, str]], windows: list[tuple[str, str]] = (("", ""),), by: str = "seed", at: str = "") -> int:
    """A mapping file with ids in the order of its values, one entry for each value and window; the number of entries."""
    rows = [(f"{field_name.upper()}_{k:04d}", "*", field_name, value, standard, "APPROVED", "1.0", lo, hi, by, at) for k, (value, standard, lo, hi) in enumerate(sorted((v, s, lo, hi) for v, s in pairs for lo, hi in windows), 1)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow("mapping_id source_system source_field source_value standard_value mapping_status confidence_score valid_from valid_to approved_by approved_at".split())
        out.writerows(rows)
    return len(rows)


class QuestionLog:
    """A line for each answer and each refusal, without the rows answered."""

    def __init__(self, path: str = ":memory:") -> None:
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS questions (trace TEXT PRIMARY KEY, at TEXT, question TEXT, metric TEXT, outcome TEXT, refusal TEXT, trust TEXT, level TEXT)")

    def note(self, trace: str, at: str, q: Question, answer: dict) -> None:
        refusal = answer.get("refusal")
        self.db.execute("INSERT OR REPLACE INTO questions VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (trace, at, json.dumps(q.__dict__, default=list), q.metric, answer["outcome"], refusal.kind if refusal else None, answer.get("trust"), answer.get("level")))
        self.db.commit()

    def read(self, trace: str) -> dict | None:
        cursor = self.db.execute("SELECT * FROM questions WHERE trace = ?", (trace,))
        row = cursor.fetchone()
        return dict(zip([c[0] for c in cursor.description], row, strict=True)) if row else None

    def counts(self) -> dict[str, int]:
        return dict(self.db.execute("SELECT outcome, count(*) FROM questions GROUP BY 1").fetchall())


@dataclass
class Tools:
    """get, compare and breakdown of a metric, its definition, trust and trace, for an actor.

    The order of checks: the capability exists, the actor may use it, the question has the right shape, the actor may ask
    it, the guard allows it after earlier suppressions. Every call is logged, refused ones too.
    """

    catalog: dict[str, Metric]
    base: DataFrame
    terms: dict[str, set]
    trust: dict = field(default_factory=dict)
    log: QuestionLog = field(default_factory=QuestionLog)
    guard: PrivacyGuard = field(default_factory=PrivacyGuard)
    calls: int = 0

    CAPABILITIES = ("get", "compare", "breakdown", "define", "trust", "trace")

    def call(self, name: str, given: dict, actor: Actor, at: str = "") -> dict:
        self.calls += 1
        trace = f"T{self.calls:06d}"
        if name not in self.CAPABILITIES:
            return {"outcome": "ERROR", "trace": trace, "error": f"no capability {name!r}"}
        if name not in actor.scopes:
            return {"outcome": "ERROR", "trace": trace, "error": "the actor may not use it"}
        if name == "trace":
            found = self.log.read(given.get("trace", ""))
            return {"outcome": "ANSWER" if found else "ERROR", "trace": trace, "log": found}
        if name in ("define", "trust"):
            m = self.catalog.get(given.get("metric", ""))
            if m is None:
                return {"outcome": "ERROR", "trace": trace, "error": "no such metric"}
            return {"outcome": "ANSWER", "trace": trace, "definition": m} if name == "define" else {"outcome": "ANSWER", "trace": trace, "trust": {cut: s for (i, cut), s in self.trust.items() if i == m.id}, "improve": _improvements(m, self.trust)}
        try:
            q = Question.parse(given)
        except QuestionShapeError as e:
            return {"outcome": "ERROR", "trace": trace, "error": str(e)}
        if name == "compare" and not q.compare or name == "breakdown" and not q.dimensions:
            return {"outcome": "ERROR", "trace": trace, "error": f"{name} needs {'a basis' if name == 'compare' else 'dimensions'}"}
        if why := actor.refused(name, q):
            return {"outcome": "ERROR", "trace": trace, "error": f"not allowed: {why}"}
        if not self.guard.allows(q):
            from lodestar.plans.questions import Refusal

            answer = {"outcome": "REFUSAL", "refusal": Refusal("PRIVACY_NARROWING", "an earlier answer was suppressed", "ask with fewer filters and no breakdown")}
        else:
            answer = ask(q, self.catalog, self.base, self.terms, self.trust)
        if name == "breakdown" and answer["outcome"] == "ANSWER":
            answer["total"] = None  # totals of parts that may be hidden or not additive are withheld
            answer["rows"] = sorted(answer["rows"], key=lambda r: (r["value"] is None, -(r["value"] or 0), str(r)))
        self.guard.note(q, answer)
        self.log.note(trace, at, q, answer)
        return answer | {"trace": trace}


def _improvements(m: Metric, trust: dict) -> list[str]:
    bad = sorted(cut for (i, cut), s in trust.items() if i == m.id and s != "CERTIFIED")
    return [f"resolve the failing checks of {cut}" for cut in bad] + ([f"certify {m.id}"] if m.status != "CERTIFIED" else [])
