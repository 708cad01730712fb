"""Every query of the engine's own operators, with its SQL."""

from __future__ import annotations

from lodestar.plans import q_events, q_facts, q_inputs, q_kpis, q_laws, q_metrics, q_model, q_more, q_rows

MODULES = (q_rows, q_metrics, q_model, q_facts, q_more, q_laws, q_events, q_inputs, q_kpis)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
