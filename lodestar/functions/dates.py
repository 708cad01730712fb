"""Dates as ISO text, their parsing, parts and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Reserved date keys: no date, and a date before the series begins.
NO_DATE, BEFORE_SERIES = -5, -7
#: Tried after the declared format, in this order.
FALLBACKS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "d/M/yy")


def _read(c: Column, pattern: str) -> Column:
    date = F.try_to_date(c, pattern)
    if pattern.endswith("/yy") or pattern.endswith("-yy"):  # two-digit years from 69 on are of the last century
        date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)
    return date


def parsed_date(c: Column, declared: str, year_now: int, first_year: int = 1950, fallbacks: tuple[str, ...] = FALLBACKS) -> Column:
    """struct(iso, parse, ambiguous); parse is ok, empty, unknown_format or out_of_window.

    The first format that reads the value wins; a value that formats read as several dates is ambiguous.
    """
    s = F.trim(c)
    read = F.array(*[_read(s, p) for p in dict.fromkeys((declared, *fallbacks))])
    found = F.array_compact(read)
    first = F.get(found, F.lit(0))
    inside = F.year(first).between(first_year, year_now + 1)
    parse = F.when(c.isNull() | (s == ""), "empty").when(first.isNull(), "unknown_format").when(~inside, "out_of_window").otherwise("ok")
    return F.struct(F.when(inside, F.date_format(first, "yyyy-MM-dd")).alias("iso"), parse.alias("parse"), (F.size(F.array_distinct(found)) > 1).alias("ambiguous"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def date_key(text: Column, series_start: str) -> Column:
    """YYYYMMDD of an ISO date; NO_DATE if there is none or it does not read; BEFORE_SERIES if it is earlier than the series."""
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(date.isNull(), F.lit(NO_DATE).cast("bigint")).when(date < F.lit(series_start).cast("date"), F.lit(BEFORE_SERIES).cast("bigint")).otherwise(F.date_format(date, "yyyyMMdd").cast("bigint"))


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quarter_of(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def half_of(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("-H"), F.when(F.month(c) <= 6, "1").otherwise("2"))


def year_of(c: Column) -> Column:
    return F.year(c).cast("string")


PERIODS = {"month": month_of, "quarter": quarter_of, "half": half_of, "year": year_of}


def month_boundaries(a: Column, b: Column) -> Column:
    """Month ends between two dates: 1 from January 31 to February 1."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")


def tenure_months(a: Column, b: Column) -> Column:
    return F.round(F.datediff(b, a) / F.lit(30.44), 2)


def in_windows(system: Column, date: Column, windows: list[tuple[str, str, str]]) -> Column:
    """Whether some (system, from, to) holds, bounds included: which source is the one of record when."""
    return F.coalesce(reduce(lambda a, b: a | b, [(system == s) & date.between(lo, hi) for s, lo, hi in windows], F.lit(False)), F.lit(False))


def previous_period(period: str, years: int = 0) -> str:
    """The period before, or the same one ``years`` earlier: 2024-01 -> 2023-12, 2024-Q1 -> 2023-Q4, 2024 -> 2023."""
    year, _, part = period.partition("-")
    if years:
        return f"{int(year) - years}" + (f"-{part}" if part else "")
    if not part:
        return str(int(year) - 1)
    kind, number, last = (part[0], int(part[1:]), {"Q": 4, "H": 2}[part[0]]) if part[0] in "QH" else ("", int(part), 12)
    back = (int(year), number - 1) if number > 1 else (int(year) - 1, last)
    return f"{back[0]}-{kind}{back[1]}" if kind else f"{back[0]}-{back[1]:02d}"
