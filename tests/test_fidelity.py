"""Raw against truth: each planted difference comes back, each declared one doesn't."""

import datetime

from pyspark.sql import functions as F

from lodestar.operators import fidelity as own

TRUTH = [(1, "a", 10.0, "x"), (2, "b", 20.0, None), (3, None, 30.0, "z"), (4, "d", 40.0, "w"), (5, "e", 50.0, "v"), (6, "f", 60.0, "u"), (None, "n", 0.0, "n")]
RAW = [("1", "a", "10.0", "x"), ("2", "B", "20.0", None), ("3", None, "30.5", "z"), ("5", "e", "50.0", "v"), ("5", "e", "50.0", "v"), ("6", None, "60.0", None), ("9", "q", None, None), (None, "n", "1", "n")]
LEDGER = [("D1", "S", 2, "name", "v"), ("D2", "S", 4, None, own.NO_COLUMN), ("D1", "S", 6, "name", "v"), ("D1", "T", 1, "name", "v"), ("D9", "S", 77, "name", "v")]


def sides(spark):
    truth = spark.createDataFrame(TRUTH, "id long, name string, pay double, grade string")
    raw = spark.createDataFrame(RAW, "id string, NOME string, PAY string, grade string")
    ledger = spark.createDataFrame(LEDGER, "defect_id string, source_system string, key long, column string, raw_value string")
    return raw, truth, ledger


def test_differences(spark):
    raw, truth, ledger = sides(spark)
    met = own.compared(raw, truth, "id", {"name": "NOME", "pay": "PAY", "grade": "grade"}, ledger)
    got = {(r.key, r.column, r.kind, r.raw, r.truth) for r in own.undeclared(met).collect()}
    assert got == {("3", "pay", "DIFFERENT", "30.5", "30.0"), ("5", None, "REPEATED", None, None), ("6", "grade", "DIFFERENT", None, "u"), ("9", None, "EXTRA", None, None)}
    assert {(r.key, r.column) for r in own.silent(met).collect()} == {("1", "name")}  # a key that neither side has says nothing
    rules = {r.rule: (r.evaluated, r.violations, r.passed) for r in own.faithful(met).collect()}
    assert rules == {"undeclared_equals_truth": (7, 4, False), "declared_shows": (4, 1, False)}


def test_one_shuffle(spark):
    raw, truth, ledger = sides(spark)
    plan = own.compared(raw, truth, "id", {"name": "NOME", "pay": "PAY"}, ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ledger_rules(spark):
    raw, truth, ledger = sides(spark)
    catalogue = spark.createDataFrame([("D1", "S"), ("D2", "S"), ("D3", "S")], "defect_id string, source_system string")
    got = {r.rule: (r.evaluated, r.violations) for r in own.in_catalogue(ledger, catalogue, ["S"]).collect()}
    assert got == {"ledger_of_these_systems": (5, 1), "ledger_in_catalogue": (5, 2), "catalogue_seen": (3, 1)}
    assert tuple(own.absent_columns(ledger, "D2").first())[2:4] == (1, 0) and own.absent_columns(ledger, "D1").first().violations == 3
    none = own.absent_columns(ledger, "D7").first()
    assert (none.evaluated, none.violations, none.passed) == (0, 1, False)  # it must be told once at least
    dated = truth.withColumn("began", F.when(F.col("id") == 6, F.lit(datetime.date(2021, 1, 1))).otherwise(F.lit(datetime.date(2019, 1, 1))))
    assert tuple(own.in_window(ledger, "D1", dated, "id", "began", ("2019-06-01", "2020-01-01")).first())[2:4] == (3, 1)
    assert [r.violations for r in own.of_count(ledger, {"D1": 4, "D9": 30}).collect()] == [0, 1]
    assert own.alike(raw, truth, (0.1, 0.2)).first().passed and not own.alike(raw, truth.limit(2), (0.1, 0.2)).first().passed


def test_schemas_and_empty_tables(spark):
    raw, truth, ledger = sides(spark)
    landed = raw.withColumns({c: F.lit("x") for c in own.TECHNICAL})
    got = {r.rule: (r.violations, r.passed) for r in own.of_schema(spark, {"raw": raw.schema, "landed": landed.schema}, forbidden={"raw": ("race", "raca")}, present={"landed": ("NOME", "id")}).collect()}
    assert got == {"technical_columns": (1, False), "raw_lacks_race_raca": (0, True), "landed_has_NOME_id": (0, True)}
    met = own.compared(raw.limit(0), truth.limit(0), "id", {"name": "NOME"}, ledger.limit(0))
    assert own.undeclared(met).collect() == [] and all(r.passed for r in own.faithful(met).collect())
