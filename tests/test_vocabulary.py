import pytest
from pyspark.sql import functions as F

from lodestar.plans import vocabulary
from lodestar.plans.q_metrics import CATALOG
from lodestar.plans.questions import PrivacyGuard, Question, Refusal, certified
from lodestar.plans.vocabulary import Meaning, Unresolved, Vocabulary, condition, relative_period

ROWS = [("1996-01", "ASIA", "Möbel & Co", True), ("1996-02", "EUROPE", "Asia", None), ("1997-01", "ASIA", "Autos", False), ("1996-01", None, None, True)]


@pytest.fixture
def words(spark):
    df = spark.createDataFrame(ROWS, "month string, region string, segment string, open boolean")
    more = {"synonyms": {"far east": ("region", "ASIA")}, "groups": {"Open ones": Meaning(predicate="open"), "Goods": Meaning("segment", ("Autos", "Möbel & Co"))}, "reserved": {"all": "it stands for no filter"}}
    return df, Vocabulary.read({"region": (df, "region"), "segment": (df, "segment")}, **more)


def test_terms(words):
    _, v = words
    assert v.resolve("Far East") == v.resolve("asia", "region") == Meaning("region", ("ASIA",))
    assert v.resolve("mobel co") == Meaning("segment", ("Möbel & Co",)) and v.resolve("OPEN ones").predicate == "open"
    for term in ("asia", "europ", "All", ""):
        with pytest.raises(Unresolved):
            v.resolve(term)
    assert v.filters(["far east", "europe", "open ones"]) == ({"region": ["ASIA", "EUROPE"]}, ["open"])
    assert v.terms()["region"] == {"ASIA", "EUROPE"}


def test_condition(words):
    df, v = words
    members, predicates = v.filters(["far east", "open ones"])
    got = df.where(condition("month", ("1996-01", "1996-12"), members, predicates, ["region", "open"])).collect()
    assert [(r.month, r.region) for r in got] == [("1996-01", "ASIA")]
    with pytest.raises(Unresolved):
        condition("month", ("1996-01", "1996-12"), members, predicates, ["region"])


def test_too_many_members(words, monkeypatch):
    df, _ = words
    monkeypatch.setattr(vocabulary, "MOST_MEMBERS", 1)
    with pytest.raises(ValueError):
        Vocabulary.read({"region": (df, "region")})


@pytest.mark.parametrize(("term", "grain", "want"), [("latest", "month", ("1998-07", "1998-07")), ("previous", "quarter", ("1998-Q2", "1998-Q2")), ("Last 3", "month", ("1998-05", "1998-07")), ("last 2", "year", ("1997", "1998")), ("year to date", "month", ("1998-01", "1998-07")), ("latest", "half", ("1998-H2", "1998-H2"))])
def test_relative_periods(term, grain, want):
    from dataclasses import replace

    m = replace(CATALOG["customers"], coverage=("1992-01", "1998-07"))
    assert relative_period(term, m, grain) == want
    with pytest.raises(Unresolved):
        relative_period("today", m, grain)
    with pytest.raises(Unresolved):
        relative_period("latest", replace(m, coverage=None), grain)


def test_caveats_and_trace(spark):
    from dataclasses import replace

    m = replace(CATALOG["customers"], status="DECLARED")
    q = Question("customers", "year", "1996", "1997", ("region",))
    rows = [{"period": "1996", "region": "UNMAPPED", "value": 1.0, "suppression": "no"}, {"period": "1996", "region": "ASIA", "value": None, "suppression": "primary"}]
    told = vocabulary.caveats(q, m, rows, {"city": "3 open"})
    assert told == ["50% of the periods have data", "region=UNMAPPED: the source value has no approved standard value", f"1 rows are withheld for groups under {m.minimum_n}", "city: 3 open", "customers is declared, not certified"]
    assert certified(replace(m, status="CERTIFIED"), q, {("customers", "ALL"): "CERTIFIED"}, 0.5) == "LIMITED"
    steps = vocabulary.trace(q, m, {"outcome": "ANSWER", "rows": rows, "trust": "LIMITED", "level": "FACT"}, "orders", ["b", "a"])
    assert [s["name"] for s in steps] == list(vocabulary.STEPS) and steps[3]["checks"] == ["a", "b"] and steps[4]["withheld"] == 1 and "ASIA" not in str(steps)
    assert vocabulary.trace(q, m, {"outcome": "REFUSAL", "refusal": Refusal("UNKNOWN_TERM", "x", "y")}, "orders", [])[5]["refusal"] == "UNKNOWN_TERM"
    guard = PrivacyGuard()
    guard.note(q, {"outcome": "ANSWER", "rows": rows})
    assert not guard.allows(Question("customers", "year", "1996", "1997", (), {"region": ["ASIA"]}))
    states = spark.createDataFrame([("UNMAPPED",), ("MISSING",), ("x",), (None,)], "s string").select(vocabulary.is_state(F.col("s")).alias("a"), vocabulary.is_pending(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in states] == [(True, True), (True, False), (False, False), (False, False)]
