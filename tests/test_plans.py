import pytest

from lodestar.operators.trust import trust
from lodestar.plans import metrics
from lodestar.plans.governance import Decisions
from lodestar.plans.q_metrics import CATALOG, order_base
from lodestar.plans.questions import Actor, PrivacyGuard, Question, QuestionShapeError, ask, changed_version, validate
from lodestar.specs import Metric

DATA = "/root/testdata/sf0.001"
TERMS = {"region": {"ASIA", "EUROPE"}}


def refused(**given):
    r = validate(Question.parse({"metric": "customers", "grain": "year", "start": "1996", "end": "1996"} | given), CATALOG, TERMS)
    return r.kind if r else None


def test_refusals():
    assert refused() is None
    assert refused(metric="nope") == "UNKNOWN_METRIC"
    assert refused(metric="margin") == "METRIC_BLOCKED"
    assert refused(version="9.0.0") == "UNKNOWN_VERSION"
    assert refused(dimensions=("colour",)) == "DIMENSION_NOT_ALLOWED"
    assert refused(filters={"region": ["asia"]}) == "UNKNOWN_TERM"
    assert refused(start="1996-13", grain="month") == "GRAIN_INCOMPATIBLE"
    assert refused(start="1980", end="1980") == "PERIOD_OUT_OF_COVERAGE"
    assert refused(metric="median_price", grain="month", start="1996-01", end="1996-01") == "GRAIN_INCOMPATIBLE"
    assert refused(grain="month", start="1995-01", end="1999-01") == "TOO_MANY_PERIODS"
    assert refused(level="CAUSALITY") == "LEVEL_WITHOUT_EVIDENCE"
    assert refused(compare="declared_period") == "COMPARISON_NOT_POSSIBLE"
    with pytest.raises(QuestionShapeError):
        Question.parse({"metric": "customers", "grain": "year", "start": "1996", "end": "1996", "sql": "SELECT 1"})


def test_ask(spark):
    base = order_base(spark, DATA)
    q = Question("order_value", "year", "1997", "1997", compare="previous_period")
    got = ask(q, CATALOG, base, TERMS, {("order_value", "ALL"): "LIMITED"})
    assert got["outcome"] == "ANSWER" and got["trust"] == "LIMITED" and got["comparison"]["possible"]
    assert got["comparison"]["base"] == ask(Question("order_value", "year", "1996", "1996"), CATALOG, base, TERMS)["value"]
    last = ask(Question("customers", "month", "1997-12", "1997-12"), CATALOG, base, TERMS)
    year = ask(Question("customers", "year", "1997", "1997"), CATALOG, base, TERMS)
    assert last["value"] == year["value"]  # a stock is that of the last month


PRIVACY = [
    ([3, 10, 20], ["primary", "complementary", "no"]), ([5, 10], ["no", "no"]), ([4, 3, 20], ["primary", "primary", "no"]), ([2], ["primary"]), ([4, 7, 7], ["primary", "complementary", "no"]),
]


@pytest.mark.parametrize(("counts", "want"), PRIVACY)
def test_privacy(spark, counts, want):
    df = spark.createDataFrame([("p", f"d{k}", float(n), n) for k, n in enumerate(counts)], "period string, d string, value double, population long")
    got = metrics.protected(df, 5, ["period"], ["d"]).orderBy("d").collect()
    assert [r.suppression for r in got] == want
    assert all((r.value is None) == (r.suppression != "no") for r in got)


def test_trust_adds_up(spark):
    results = spark.createDataFrame([("a", "ALL", "BLOCKER", "INVALID", 100, 10), ("b", "ALL", "CRITICAL", "UNMAPPED", 100, 50), ("c", "ALL", "WARNING", "INVALID", 100, 100), ("d", "ALL", "CRITICAL", "LEGITIMATELY_ABSENT", 100, 100)], "check_id string, cut string, severity string, finding string, evaluated long, failed long")
    depends = spark.createDataFrame([("m", c) for c in "abcd"] + [("pending", "b")], "metric string, check_id string")
    got = {r.metric: r for r in trust(results, depends).collect()}
    assert (got["m"].trust_score, got["m"].loss_by_error, got["m"].loss_by_pendency, got["m"].status, got["m"].checks) == (0.7, 0.05, 0.25, "LIMITED", 2)
    assert (got["pending"].trust_score, got["pending"].status, got["pending"].reason) == (0.5, "LIMITED", "PENDENCY")


def test_decisions():
    g = Decisions()
    g.found("city", "Rio", 3)
    with pytest.raises(ValueError):
        g.move("city", "Rio", "APPROVED", "ann", "a long enough reason", "2024-01-01", "RJ")
    g.move("city", "Rio", "UNDER_REVIEW", "ann", "looks like a city", "2024-01-01")
    with pytest.raises(ValueError):
        g.move("city", "Rio", "APPROVED", "ann", "a long enough reason", "2024-01-02")
    g.move("city", "Rio", "APPROVED", "ann", "a long enough reason", "2024-01-02", "RJ")
    g.found("city", "new", 1)
    g.reset()
    assert g.queue() == [("city", "Rio", "APPROVED", 0)] and g.approved() == [("city", "Rio", "RJ")] and len(g.history("city", "Rio")) == 2


def test_guard_and_actor():
    guard = PrivacyGuard()
    q = Question("customers", "year", "1996", "1996", (), {"region": ["ASIA"], "segment": ["BUILDING"]})
    guard.note(q, {"outcome": "SUPPRESSED"})
    assert guard.allows(Question("customers", "year", "1996", "1996", (), {"region": ["ASIA"]}))
    assert not guard.allows(Question("customers", "year", "1996", "1996", (), {"region": ["EUROPE"]}))
    assert not guard.allows(Question("customers", "year", "1996", "1996", ("nation",), {}))
    actor = Actor(frozenset({"get"}), frozenset({"segment"}))
    assert actor.refused("get", q) == "DIMENSION" and actor.refused("compare", q) == "SCOPE"


def test_versions_of_metrics():
    from dataclasses import replace

    m = CATALOG["customers"]
    assert changed_version(m, replace(m, measure="sum")) == "2.0.0"
    assert changed_version(m, replace(m, minimum_n=9)) == "1.1.0"
    assert changed_version(m, m) == "1.0.0"


def test_contracts():
    from lodestar.plans.contracts import derived, inconsistencies
    from lodestar.specs import Check

    checks = [Check("a", "t", "not_null", metrics=("customers",)), Check("b", "t", "not_null", metrics=("customers", "gone")), Check("c", "t", "not_null")]
    assert derived(checks) == {"customers": ["a", "b"], "gone": ["b"]}
    assert inconsistencies(checks, CATALOG, {"customers": ["a", "x"]}) == ["check c feeds no metric", "checks feed gone, which has no contract", "customers depends on x, which does not exist", "customers: missing ['b'], extra ['x']"]


def test_tools(spark):
    from lodestar.plans.contracts import Tools

    tools = Tools(CATALOG, order_base(spark, DATA), TERMS, {("order_value", "ALL"): "LIMITED"})
    actor = Actor(frozenset({"get", "breakdown", "trust", "trace"}))
    year = {"metric": "order_value", "grain": "year", "start": "1997", "end": "1997"}
    got = tools.call("get", year, actor)
    assert got["outcome"] == "ANSWER" and tools.call("trace", {"trace": got["trace"]}, actor)["log"]["outcome"] == "ANSWER"
    rows = tools.call("breakdown", year | {"dimensions": ("region",)}, actor)["rows"]
    shown = [r["value"] for r in rows if r["value"] is not None]
    assert shown == sorted(shown, reverse=True)
    assert tools.call("compare", year, actor)["error"] == "the actor may not use it"
    assert tools.call("sql", {}, actor)["outcome"] == tools.call("get", {"sql": "x"}, actor)["outcome"] == "ERROR"
    assert tools.call("trust", {"metric": "order_value"}, actor)["improve"] == ["resolve the failing checks of ALL"]
    assert tools.log.counts() == {"ANSWER": 2}


def test_mapping_file(tmp_path):
    from lodestar.plans.contracts import write_mapping

    assert write_mapping(f"{tmp_path}/m.csv", "level", [("b", "B"), ("a", "A")], [("", "2020-12-31"), ("2021-01-01", "")]) == 4
    assert (tmp_path / "m.csv").read_text().splitlines()[1].startswith("LEVEL_0001,*,level,a,A,APPROVED")


def test_last_periods_are_sent_to_the_rows(spark):
    """The few periods that stay are broadcast; rows are not shuffled for them."""
    base = spark.createDataFrame([(f"2020-{m:02d}", "2020", e) for m in (1, 2, 12) for e in range(m)] + [("2021-03", "2021", 7), (None, "2022", 8)], "month string, year string, entity int")
    rows = metrics.last_period_rows(base, "month", "year")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(rows.groupBy("month").count().collect()) == [("2020-12", 12), ("2021-03", 1)]


def test_medians_carry_no_buffer_for_each_member(spark):
    """Medians come from counts of values; rows without a value or a dimension count for the population alone."""
    rows = [("2020", "a", 1, 4), ("2020", "a", 1, 4), ("2020", "a", 2, 9), ("2020", "a", 3, None), ("2020", None, 4, 7), ("2021", "a", 5, None), (None, "a", 6, 1)]
    base = spark.createDataFrame(rows, "year string, part string, id int, days int")
    got = metrics.evaluated(Metric("m", "median", "days", population="id", dimensions=("part",), grain="year"), base, "year", dimensions=("part",))
    assert {tuple(r) for r in got.collect()} == {("2020", "a", 4.0, 3), ("2020", None, 7.0, 1), ("2021", "a", None, 1), (None, "a", 1.0, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and not any("percentile(" in x and "count(" in x for x in plan.splitlines())
