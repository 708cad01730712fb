import pytest
from pyspark.sql import functions as F

from lodestar.operators import identity, lookups, mapping, profile, quality, reconcile, standardize, versions
from lodestar.specs import Check, StandardSpec


def test_as_of_against_brute_force(spark):
    versions_ = [("a", 1, 10), ("a", 40, 11), ("a", 40, 12), ("b", 5, 20), (None, 1, 30), ("c", None, 40)]
    rows = [(k, t) for k in ("a", "b", "c", None) for t in (0, 1, 39, 40, 41, 500, None)]
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    v = spark.createDataFrame(versions_, "k string, d int, v int").select("k", stamp("d").alias("since"), "v")
    r = spark.createDataFrame(rows, "k string, d int").select("k", "d", stamp("d").alias("at"))
    got = {(x.k, x.d): x.v for x in lookups.as_of(r, v, "k", "at", "since", ["v"]).collect()}
    want = {(k, t): max(((d, w) for q, d, w in versions_ if k is not None and q == k and t is not None and d is not None and d <= t), default=(0, None))[1] for k, t in rows}
    assert got == want


def test_interval_lookup(spark):
    table = spark.createDataFrame([("a", "X", "1", "", "2019-12-31", 0), ("a", "Y", "2", "2019-06-01", "", 1), (None, "Z", "3", "", "", 2)], "key string, standard_value string, mapping_id string, valid_from string, valid_to string, ordinal int")
    df = spark.createDataFrame([(1, "a", "2018-01-01"), (2, "a", "2019-08-01"), (3, "a", "2021-01-01"), (4, "a", None), (5, "b", "2020-01-01"), (6, None, None)], "i int, k string, d string")
    assert [(r.i, r.mapping_id) for r in lookups.interval_lookup(df, table, "k", "d").orderBy("i").collect()] == [(1, "1"), (2, "1"), (3, "2"), (4, "2"), (5, None), (6, None)]


def test_key_or_never_matches_nulls(spark):
    dim = spark.createDataFrame([(7, "x", None), (8, "x", "y")], "sk long, a string, b string")
    df = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, None)], "i int, a string, b string")
    assert [r.sk2 for r in lookups.key_or(df, dim, [("a", "a"), ("b", "b")], "sk", "sk2", -1).orderBy("i").collect()] == [-1, 8, -1]


def test_change_log_replays(spark):
    df = spark.createDataFrame([("r1", " a  b "), ("r2", ""), ("r3", "ok"), ("r4", None)], "_row_id string, x string")
    log = [(r.row_id, r.rule, r.old, r.new) for r in standardize.change_log(df, ["x"]).collect()]
    assert sorted(log, key=repr) == [("r1", "COLLAPSE", "a  b", "a b"), ("r1", "TRIM", " a  b ", "a  b"), ("r2", "EMPTY_TO_NULL", "", None)]
    assert {r["rule"]: r["values"] for r in standardize.rule_histogram(standardize.change_log(df, ["x"])).collect()} == {"TRIM": 1, "COLLAPSE": 1, "EMPTY_TO_NULL": 1}
    out = standardize.standardized(df.withColumn("d", F.lit("1/2/2020")), StandardSpec(dates={"d": "d/M/yyyy"}), 2024)
    assert out.columns == ["_row_id", "x", "d", "d__iso", "d__parse", "d__ambiguous"]


def test_every_expectation_is_known(spark):
    assert len(quality.ALL_KINDS) == len(set(quality.ALL_KINDS)) == 23


def test_missing_column_is_not_run(spark):
    df = spark.createDataFrame([(1,)], "a int")
    got = quality.run([Check("x", "t", "not_null", "b"), Check("y", "other", "unique", "a"), Check("z", "t", "not_null", "a"), Check("e", "t", "unique", "a", scope={"column": "a", "equals": 5})], {"t": df}).collect()
    assert {r.check_id: r.status for r in got} == {"x": "NOT_RUN", "y": "NOT_RUN", "z": "PASS", "e": "NOT_RUN"}


def test_quarantine_is_by_severity(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "b")], "_row_id int, x string")
    checks = [Check("n", "t", "not_null", "x", "BLOCKER", most=1.0), Check("u", "t", "unique", "x", "CRITICAL")]
    good, bad = quality.quarantined(df, checks)
    assert sorted(r._row_id for r in good.collect()) == [2, 3, 4]
    assert [(r.row_id, r.check_id) for r in bad.collect()] == [(1, "n")]


def test_mapping_is_never_guessed(spark):
    table = spark.createDataFrame([("São Paulo", "SP", "1", "APPROVED", None, None, 0), ("Rio", "RJ", "2", "OPEN", None, None, 1)], "source_value string, standard_value string, mapping_id string, mapping_status string, valid_from string, valid_to string, ordinal int")
    df = spark.createDataFrame([(1, "SAO  PAULO"), (2, "Rio"), (3, None)], "i int, city string").withColumn("d", F.lit("2020-01-01"))
    assert [(r.std_city, r.std_city__mapping_id) for r in mapping.mapped(df, table, "city", "d", "city").orderBy("i").collect()] == [("SP", "1"), ("UNMAPPED", None), (None, None)]


def test_identity_never_promotes(spark):
    anchor = spark.createDataFrame([(1, "ann", "2020"), (2, "bob", "2020"), (3, "bob", "2020"), (4, "cy", None)], "entity_id long, name string, date string")
    people = spark.createDataFrame([("p1", 1, "x", None), ("p2", None, "ann", "2020"), ("p3", None, "bob", "2020"), ("p4", None, "cy", "1999"), ("p5", None, "bob", None), ("p6", 99, None, None)], "source_id string, id long, name string, date string")
    got = {r.source_id: (r.match_status, r.entity_id, r.method) for r in identity.resolved(people, anchor, "s").collect()}
    assert got == {"p1": ("RESOLVED", 1, "exact_id"), "p2": ("MANUAL_REVIEW", 1, "name_date"), "p3": ("AMBIGUOUS", None, "name_date"), "p4": ("MANUAL_REVIEW", 4, "name"), "p5": ("AMBIGUOUS", None, "name"), "p6": ("UNRESOLVED", None, "none")}
    assert [(r.name, r.ids) for r in identity.suspected_duplicates(anchor).collect()] == [("bob", 2)]


def test_versions(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", 1, "x"), ("a", "2020-02-01", 2, "x"), ("a", "2020-03-01", 3, None), ("a", "2020-04-01", 4, None), ("a", "2020-05-01", 5, "x")], "e string, d string, k int, v string")
    got = versions.closed(versions.islands(rows.withColumn("d", F.col("d").cast("date")), "e", ["d", "k"], ["v"]), "e").orderBy("version").collect()
    assert [(str(r.effective_from), r.effective_to, r.v, r.observations, r.is_current) for r in got] == [("2020-01-01", "2020-02-29", "x", 2, False), ("2020-03-01", "2020-04-30", None, 2, False), ("2020-05-01", "9999-12-31", "x", 1, True)]
    bad = spark.createDataFrame([("a", "2020-01-01", "2020-03-01", False), ("a", "2020-02-01", "2020-04-01", False), ("a", "2020-06-01", "9999-12-31", True), ("b", "2020-01-01", "2020-02-01", False)], "e string, effective_from string, effective_to string, is_current boolean")
    assert sorted((r.e, r.fault) for r in versions.history_faults(bad, "e").collect()) == [("a", "GAP"), ("a", "OVERLAP"), ("b", "NOT_ONE_CURRENT")]


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert reconcile.content_hash(a).first() == reconcile.content_hash(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert reconcile.content_hash(a).first() != reconcile.content_hash(a.fillna("")).first()


def test_six_decimals_as_printf(spark):
    import random

    rnd = random.Random(3)
    values = [-0.0703125, 0.0078125, 0.0234375, 1.0000005, 1.0000035, 0.0, -0.0, 0.9999995, 0.99999951, 2147483648.9999998, 12345678901234.567, -(2.0**40) - 2**-7, 2.0**62, float("nan"), float("inf")]
    values += [s * rnd.randrange(10**k) * 1e-7 for k in range(1, 15) for s in (1, -1) for _ in range(200)] + [rnd.randrange(-(2**12), 2**12) / 128 for _ in range(500)] + [rnd.uniform(-1e9, 1e9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(reconcile.six_decimals(F.col("v")).alias("t")).collect()] == ["%.6f" % v for v in values]
    floats = spark.createDataFrame([([-0.0703125, 0.0078125, None],)], "a array<float>")
    assert floats.select(reconcile.as_text(F.col("a"), floats.schema["a"].dataType)).first()[0] == "-0.070312,0.007812,?"


def test_a_version_replaced_on_its_first_day_is_no_fault(spark):
    rows = [("a", "2020-01-01", "2020-01-31"), ("a", "2020-02-01", "9999-12-31"), ("a", "2020-02-01", "2020-01-31"), ("a", "2020-02-01", "2020-01-31")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, r[2] == versions.OPEN_END) for r in order], "e string, effective_from string, effective_to string, is_current boolean").coalesce(1)
        assert versions.history_faults(df, "e").collect() == []


def test_as_of_deals_rows_without_a_key(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 0, F.col("id")).alias("k"), F.timestamp_seconds("id").alias("at"), "id")
    known = spark.createDataFrame([(1, 1)], "k long, v int").withColumn("since", F.timestamp_seconds("v"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r["count"] for r in lookups.as_of(rows, known, "k", "at", "since", ["v"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_provenance():
    same = {"seed": 1, "profile": "x", "scale": 2}
    assert reconcile.provenance({"a": same, "b": dict(same)})["status"] == "OK"
    assert reconcile.provenance({"a": same, "b": same | {"seed": 2}})["differs"] == [("a", "b", "seed")]


def chain(n, first=1000):
    return [(first + k, first + k + 1) for k in range(n)]


@pytest.mark.parametrize(
    ("edges", "want"),
    [([(1, 2), (2, 3), (3, 1), (4, 1)], {1, 2, 3}), ([(1, 2), (2, None)], set()), ([(5, 5)], {5}), ([], set()), ([(None, 1), (1, None)], set())]
    + [(chain(n), set()) for n in (63, 64, 65, 200, 1000)]
    + [([*chain(300), (1300, 7), (7, 8), (8, 9), (9, 7)], {7, 8, 9}), ([*chain(99), (1099, 1000)], set(range(1000, 1100))), ([*chain(130), (1130, 2), (2, 2), *chain(70, 5000)], {2})],
)
def test_cycles(spark, edges, want):
    df = spark.createDataFrame(edges, "n int, p int")
    assert {r.node for r in reconcile.cycles(spark, df, "n", "p").collect()} == want


def test_profile_of_empty(spark):
    got = profile.profiled(spark.createDataFrame([], "a string"), ["a"]).collect()
    assert got[0].rows == 0 and got[0].min_length is None


def test_layers(spark):
    from lodestar.operators import layers

    df = spark.createDataFrame([(1,)], "a int")
    assert layers.asserted(layers.stamped(df, "L3"), "L3").count() == 1
    with pytest.raises(layers.LayerError):
        layers.asserted(df, "L3")
    with pytest.raises(layers.LayerError):
        layers.asserted(layers.stamped(df, "truth"), "L3")
    run = layers.Run("r", "2024-01-01")
    run.made("dim", ["a", "b"], 3)
    with run.stage("x", 10):
        df.count()
    assert run.lineage(spark).first().inputs == "a,b" and run.timing(spark).first().micros_per_row > 0 and run.projected_minutes(10) > 0


def test_outranked_against_brute_force(spark):
    import datetime as dt
    import random

    from lodestar.operators.calibration import outranked

    rnd, day = random.Random(3), dt.date(2024, 1, 20)
    rows = [(k, rnd.randint(1, 5), day + dt.timedelta(rnd.randint(0, 60)), rnd.choice([None, 0, 3, 40])) for k in range(80)]
    rows = [(k, r, s, None if n is None else s + dt.timedelta(n)) for k, r, s, n in rows]
    got = {x.k for x in outranked(spark.createDataFrame(rows, "k int, r int, s date, e date"), "k", "r", "s", "e").collect()}
    assert got == {k for k, r, s, _ in rows if any(q > r and a <= s and (z is None or s <= z) for _, q, a, z in rows)}


def test_entities(spark):
    from lodestar.operators import entities

    people = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "x"), (4, None, None)], "k int, system string, id string")
    xref = spark.createDataFrame([("A", "x", 7, "MANUAL_REVIEW", 0.9), ("A", "x", 8, "RESOLVED", 1.0), ("A", "x", 8, "RESOLVED", 1.0), ("A", "y", 9, "MANUAL_REVIEW", 0.85), (None, None, 5, "RESOLVED", 1.0)], "source_system string, source_id string, entity_id int, match_status string, confidence double")
    got = {r.k: (r.cross_id, r.match_status) for r in entities.attach_identity(people, xref, "system", "id").collect()}
    assert got == {1: (8, "RESOLVED"), 2: (None, "MANUAL_REVIEW"), 3: (None, None), 4: (None, None)}
    waits = {(r.source_id, r.entity_id): r.state for r in entities.queue(xref, spark.createDataFrame([("A", "x", 7), ("A", "y", 6)], "source_system string, source_id string, entity_id int")).collect()}
    assert waits == {("y", 9): "STALE"}
    assert {r.state for r in entities.queue(xref).collect()} == {"OPEN"}


def test_worst_and_orphans(spark):
    rows = spark.createDataFrame([("2024-01", 0.1), ("2024-02", -0.3), ("2024-03", 0.3), ("2024-04", None)], "month string, deviation double")
    assert tuple(reconcile.worst(rows).first()) == (3, 0.233333, 0.3, "2024-02")
    people = spark.createDataFrame([(1, None), (2, 1), (3, 9), (None, 9)], "k int, p int")
    assert sorted((str(r.k), r.p) for r in reconcile.orphans(people, "k", "p").collect()) == [("3", 9), ("None", 9)]


def test_values_awaiting_decision():
    from lodestar.operators.mapping import awaiting_decision

    assert awaiting_decision({"CORE": ["L1", "L2"], "BOUGHT": ["N1", "L2"], "OTHER": []}, "CORE") == ["N1"]


def test_key_rules_share_a_scan(spark):
    """Against plain counts, with cuts, null keys, scopes and references; each dataset is read once."""
    import random
    from collections import Counter

    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice("abc"), rnd.choice([None, "x", "y"]), rnd.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, b string, cut string, s int")
    known = spark.createDataFrame([(str(k), "RESOLVED" if k % 2 else "PENDING", "S") for k in range(20)] + [("1", "RESOLVED", "T")], "source_id string, match_status string, source_system string")
    other = spark.createDataFrame([(k,) for k in [*range(0, 25), None, 3, 3]], "ref long")
    checks = [
        Check("u", "t", "unique", "k"), Check("cu", "t", "compound_unique", args={"columns": ("k", "b")}), Check("r", "t", "in_reference", "k", args={"reference": "o", "column": "ref"}), Check("rs", "t", "in_reference", "k", args={"reference": "o", "column": "ref"}, scope={"column": "s", "equals": 2}),
        Check("i", "t", "identity_resolved", "k", args={"reference": "m", "system": "S"}), Check("none", "t", "identity_resolved", "b", args={"reference": "m", "system": "S"}), Check("self", "o", "unique", "ref"),
    ]
    frames = {"t": df, "o": other, "m": known}
    got = {(r.check_id, r.cut): (r.evaluated, r.failed, r.status) for r in quality.run(checks, frames, {"t": ["cut"]}).collect()}

    def unique(some, key):
        n = Counter(key(r) for r in some)
        return len(some), sum(n[key(r)] > 1 for r in some if None not in key(r))

    for label, some in [("ALL", rows), *[(f"cut={v or ''}", [r for r in rows if r[2] == v]) for v in (None, "x", "y")]]:
        assert got["u", label][:2] == unique(some, lambda r: (r[0],)) and got["cu", label][:2] == unique(some, lambda r: (r[0], r[1]))
        asked = [r for r in some if r[0] is not None]
        assert got["r", label][:2] == (len(asked), sum(r[0] >= 25 for r in asked))
        assert got["rs", label][:2] == (sum(r[3] == 2 for r in asked), sum(r[0] >= 25 and r[3] == 2 for r in asked))
    asked = [r for r in rows if r[0] is not None]
    assert got["i", "ALL"][:2] == (len(asked), sum(not (r[0] < 20 and r[0] % 2) for r in asked))
    assert got["none", "ALL"] == (0, 0, "NOT_RUN") and got["self", "ALL"][:2] == (28, 3)
    plan = quality.key_rules(checks, frames, {"t": ["cut"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3 + 1  # one for each dataset, one for the cuts of a key
    empty = quality.run(checks[:1], {"t": df.limit(0)}, {"t": ["cut"]}).collect()
    assert [(r.check_id, r.cut, r.evaluated, r.status) for r in empty] == [("u", "ALL", 0, "NOT_RUN")]
