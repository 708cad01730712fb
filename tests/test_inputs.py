import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import keys, text
from lodestar.operators import inputs, mapping, quality
from lodestar.operators.calibration import outranked
from lodestar.plans import kpis
from lodestar.plans.q_kpis import PLANS
from lodestar.plans.questions import ceiling, effective_level
from lodestar.specs import Check, InputSpec, Metric

XREF = "source_system string, source_id string, entity_id string, match_status string, confidence double"


def test_persons_of_rows(spark):
    xref = spark.createDataFrame([("A", "2", "20", "RESOLVED", 1.0), ("A", "2", "20", "RESOLVED", 1.0), ("A", "3", "30", "MANUAL_REVIEW", 0.9), (None, None, "1", "RESOLVED", 1.0)], XREF)
    df = spark.createDataFrame([("A", "1", " 10 "), ("A", "2", ""), ("A", "3", None), ("A", None, None), ("B", "2", None), ("A", "2", "")], "s string, i string, own string")
    got = sorted(inputs.with_person(df, xref, "s", "i", "own").select("person", "identity_basis", "identity_status", "provisional").collect())
    assert got == [
        ("ID:10", "own", "RESOLVED", False), ("ID:20", "cross_reference", "RESOLVED", False), ("ID:20", "cross_reference", "RESOLVED", False), ("SRC:A:", "unresolved", "UNRESOLVED", True),
        ("SRC:A:3", "unresolved", "MANUAL_REVIEW", True), ("SRC:B:2", "unresolved", "UNRESOLVED", True),
    ]
    assert inputs.with_person(df.limit(0), xref, "s", "i").count() == 0


def test_normalised_names(spark):
    xref = spark.createDataFrame([], XREF)
    frames = {("A", "x"): spark.createDataFrame([(1, 5, "extra")], "k int, v int, person string"), ("B", "y"): spark.createDataFrame([("u", "w")], "k string, n string")}
    specs = [InputSpec("A", "x", "k", (("value", "v"), ("name", None))), InputSpec("B", "y", "k", (("name", "n"), ("value", "gone"))), InputSpec("C", "z", "k", (("name", "n"),))]
    got = sorted(map(tuple, inputs.normalised(frames, specs, xref).select("source_system", "source_id", "source_row_id", "value", "name", "person").collect()))
    assert got == [("A", "1", None, "5", None, "SRC:A:1"), ("B", "u", None, None, "w", "SRC:B:u")]
    with pytest.raises(ValueError):
        inputs.normalised({}, specs, xref)


def test_origins(spark):
    rows = [("P", "1", "a", "10", "1990-01-01"), ("Q", "2", "a", "10", "1990-01-01"), ("Q", "3", "b", "11", "2001-01-01"), ("Q", "4", "c", None, ""), ("Q", "5", "d", "12", None), ("Q", "6", "d", "12", "1999-01-01")]
    masters = spark.createDataFrame([(s, i, p, e, t, p == "c") for s, i, p, e, t in rows], "source_system string, source_row_id string, person string, entity_id string, start string, provisional boolean")
    applied = spark.createDataFrame([("x", 11, "2001-01-01"), ("x", 11, "2000-05-05"), ("y", 12, "2001-01-01"), ("x", 13, ""), ("x", None, "2001-01-01")], "c string, e int, h string")
    xref = spark.createDataFrame([("S", "x", "11", "RESOLVED", 1.0), ("S", "y", "12", "AMBIGUOUS", 0.6), ("T", "y", "12", "RESOLVED", 1.0)], XREF)
    found = inputs.evidence(applied, xref, "S", "c", "e", "h")
    assert [tuple(r) for r in found.collect()] == [("11", "2000-05-05")]
    told = inputs.determined(masters, found, {"P": "BOUGHT"}, "2000-01-01")
    people = {r.person: (r.origin, r.rule, r.records, r.systems, r.evidence_system) for r in inputs.persons(told).collect()}
    assert people == {"a": ("BOUGHT", "P1", 2, 2, "P"), "b": ("HIRED", "P3", 1, 1, "Q"), "c": ("UNDETERMINED", None, 1, 1, None), "d": ("INITIAL", "P2", 2, 1, "Q")}
    got = {(r.section, r.member): r.n for r in inputs.summary(inputs.persons(told), {"masters": masters}, "BOUGHT").collect()}
    assert got[("persons", "ALL")] == 4 and got[("persons", "PROVISIONAL")] == 1 and got[("rows", "masters")] == 6 and got[("rule", "NONE")] == 1 and got[("contamination", "AT_MOST")] == 1
    empty = {(r.section, r.member): r.n for r in inputs.summary(inputs.persons(told.limit(0)), {}, "BOUGHT").collect()}
    assert empty == {("persons", "ALL"): 0, ("persons", "PROVISIONAL"): 0, ("contamination", "UNDETERMINED"): 0, ("contamination", "AT_MOST"): 0}


def test_members_and_numbers(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(keys.member_of(F.col("v"), {"a": "A"}, "none")).collect()] == ["A", "none", "none"]
    assert [r[0] for r in df.select(keys.member_of(F.col("v"), {})).collect()] == [None] * 3
    given = [" 12 ", "+5", "-7", "1.5", "", "x", None, "99999999999999999999", "1 2"]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in given], "v string").select(text.lenient_int(F.col("v"))).collect()] == [12, 5, -7, None, None, None, None, None, None]


def test_queue_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", None)], "source_value string, occurrences int")
    assert [(r.source_value, r.place) for r in mapping.in_order(df, "occurrences", "source_value").orderBy("place").collect()][1:] == [("c", 2), ("a", 3), ("b", 4)]


def test_outranked_wide_spans(spark):
    rnd = random.Random(8)
    days = [dt.date(1, 1, 1), dt.date(9999, 12, 31), *[dt.date(2000, 1, 1) + dt.timedelta(rnd.randint(0, 4000)) for _ in range(60)]]
    rows = [(k, rnd.choice([1, 2, 3, None]), rnd.choice([*days, None]), rnd.choice([*days, None])) for k in range(250)]
    got = {x.k for x in outranked(spark.createDataFrame(rows, "k int, r int, s date, e date"), "k", "r", "s", "e").collect()}
    assert got == {k for k, r, s, _ in rows if r and s and any(q and a and q > r and a <= s and (z is None or s <= z) for _, q, a, z in rows)}


def test_levels_of_answers():
    m = lambda **more: Metric("m", "sum", **more)
    assert [ceiling(m(status=s)) for s in ("DRAFT", "BLOCKED", "DECLARED", "CERTIFIED")] == [None, None, "CONTEXT", "CONTEXT"]
    ruled, studied = m(rules=("r",)), m(studies=("s",))
    assert ceiling(ruled) == "INTERPRETATION" and ceiling(studied) == "CAUSALITY" and ceiling(m(status="DECLARED", studies=("s",))) == "CONTEXT"
    assert effective_level("INTERPRETATION", ruled, "CERTIFIED") == ("INTERPRETATION", None)
    assert effective_level("INTERPRETATION", ruled, "LIMITED")[0] == "CONTEXT" and effective_level("FACT", ruled, "LIMITED") == ("FACT", None)
    assert effective_level("FACT", ruled, "UNDETERMINED")[0] is None and effective_level("FACT", ruled, "BLOCKED")[0] is None
    assert effective_level("CAUSALITY", m(), None)[0] == "CONTEXT" and effective_level("FACT", m(status="DRAFT"), None)[0] is None


def test_identity_as_datasets(spark):
    xref = spark.createDataFrame([("A", "1", "10", "RESOLVED", 1.0), ("A", "2", "10", "RESOLVED", 1.0), ("A", "3", None, "AMBIGUOUS", 0.6)], XREF)
    frames = quality.with_identity({"t": spark.createDataFrame([("10",), ("11",)], "e string")}, xref)
    assert [r.entity_id for r in frames["identity"].collect()] == ["10"] and frames["identity_xref"].count() == 3
    got = quality.run([Check("known", "t", "in_reference", "e", args={"reference": "identity", "column": "entity_id"})], frames).first()
    assert (got.evaluated, got.failed) == (2, 1)
    with pytest.raises(ValueError):
        Check("x", "t", "not_null", finding="WRONG")


def test_plans_refuse(spark):
    assert len(PLANS) == 13
    for grain, dims in (("year", ("shoe_size",)), ("week", ())):
        with pytest.raises(ValueError):
            kpis.evaluated(PLANS["headcount"], {}, grain, dims)


def test_plan_leaves_the_undeclared_out_of_both_sides(spark):
    rows = [("2020-12", "2020", 1, 1, True), ("2020-12", "2020", 2, None, True), ("2020-12", "2020", 3, 3, False), ("2020-11", "2020", 4, 4, True)]
    base = spark.createDataFrame(rows, "month string, year string, entity int, in_group int, declared boolean")
    got = kpis.evaluated(PLANS["group_representation"], {"stock": base}, "year").first()
    assert (got.value, got.numerator, got.denominator, got.population, got.undeclared) == (0.5, 1.0, 2.0, 2, round(1 / 3, 6))
