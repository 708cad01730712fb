"""Decisions about exceptions: few, mutable, made by people, so a driver-side SQLite file and no Spark table."""

from __future__ import annotations

import sqlite3

MOVES = {"OPEN": {"UNDER_REVIEW"}, "UNDER_REVIEW": {"APPROVED", "REJECTED", "OPEN"}, "APPROVED": {"DEPRECATED"}, "REJECTED": {"OPEN"}, "DEPRECATED": set()}
LEAST_RATIONALE = 10


class Decisions:
    def __init__(self, path: str = ":memory:") -> None:
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS exceptions (field TEXT, value TEXT, status TEXT, occurrences INTEGER, standard TEXT, PRIMARY KEY (field, value))")
        self.db.execute("CREATE TABLE IF NOT EXISTS moves (field TEXT, value TEXT, before TEXT, after TEXT, who TEXT, why TEXT, at TEXT)")

    def reset(self) -> None:
        """Before a run: open entries go, decided ones keep their status and count anew."""
        self.db.execute("DELETE FROM exceptions WHERE status = 'OPEN'")
        self.db.execute("UPDATE exceptions SET occurrences = 0")
        self.db.commit()

    def found(self, field: str, value: str, occurrences: int) -> None:
        self.db.execute("INSERT INTO exceptions VALUES (?, ?, 'OPEN', ?, NULL) ON CONFLICT DO UPDATE SET occurrences = occurrences + excluded.occurrences", (field, value, occurrences))
        self.db.commit()

    def move(self, field: str, value: str, status: str, who: str, why: str, at: str, standard: str | None = None) -> None:
        """One entry at a time; an approval names its value, and every move its reason."""
        row = self.db.execute("SELECT status FROM exceptions WHERE field = ? AND value = ?", (field, value)).fetchone()
        if row is None:
            raise KeyError((field, value))
        if status not in MOVES[row[0]]:
            raise ValueError(f"{row[0]} does not become {status}")
        if len(why.strip()) < LEAST_RATIONALE:
            raise ValueError("the reason is too short")
        if status == "APPROVED" and not standard:
            raise ValueError("an approval names its value")
        self.db.execute("UPDATE exceptions SET status = ?, standard = coalesce(?, standard) WHERE field = ? AND value = ?", (status, standard, field, value))
        self.db.execute("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?, ?)", (field, value, row[0], status, who, why, at))
        self.db.commit()

    def approved(self) -> list[tuple[str, str, str]]:
        return self.db.execute("SELECT field, value, standard FROM exceptions WHERE status = 'APPROVED' ORDER BY field, value").fetchall()

    def queue(self) -> list[tuple]:
        return self.db.execute("SELECT field, value, status, occurrences FROM exceptions ORDER BY occurrences DESC, field, value").fetchall()

    def history(self, field: str, value: str) -> list[tuple]:
        return self.db.execute("SELECT before, after, who, why, at FROM moves WHERE field = ? AND value = ? ORDER BY rowid", (field, value)).fetchall()
