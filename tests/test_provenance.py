from pyspark.sql import functions as F

from lodestar.operators import facts, provenance


def test_rows_behind_an_answer(spark):
    rows = spark.createDataFrame([("a", 1, "r1", 2.0), ("a", 1, "r2", 3.0), ("b", None, "r3", 5.0), ("b", 2, "r4", 7.0), (None, 1, "r5", None)], "g string, p int, id string, v double")
    answer = rows.groupBy("g", "p").agg(F.sum("v").alias("total")).where("coalesce(g, '') <> 'b' OR p IS NULL")
    log = spark.createDataFrame([("r1", "TRIM"), ("r1", "CASE"), ("r1", "TRIM"), ("r4", "CASE"), (None, "TRIM")], "row_id string, rule string")
    traced = provenance.rows_behind(answer, rows, ["g", "p"], "id", "v", log)
    assert sorted((r.id, r.changes, r.rules) for r in traced.collect()) == [("r1", 3, "CASE,TRIM"), ("r2", 0, ""), ("r3", 0, ""), ("r5", 0, "")]
    assert sorted((r.g or "", r.rows, r.changed, r.agrees) for r in provenance.explained(answer, traced, ["g", "p"], "total", "v").collect()) == [("", 1, 0, True), ("a", 2, 1, True), ("b", 1, 0, True)]
    wrong = answer.withColumn("total", F.col("total") + 1)
    assert sorted(r.agrees for r in provenance.explained(wrong, traced, ["g", "p"], "total", "v").collect()) == [False, False, True]
    bare = provenance.rows_behind(answer, rows, ["g", "p"], "id", "v")
    assert bare.columns == traced.columns and bare.where("changes <> 0").isEmpty()
    assert provenance.rows_behind(answer.where("false"), rows, ["g", "p"], "id", "v", log).isEmpty()


def test_keys_as_of_the_day(spark):
    events = spark.createDataFrame([(1, "p", "2020-01-01", "A"), (2, "p", "2020-06-01", "Z"), (3, "p", "2019-01-01", None), (4, None, "2020-06-01", "A"), (5, "p", None, "A"), (6, "p", "no day", "A")], "k int, who string, day string, system string")
    versions = spark.createDataFrame([("p", "2020-01-01", 10), ("p", "2020-06-01", 11), ("q", "2019-01-01", 12)], "who string, s string, entity_sk long").select("who", F.to_timestamp("s").alias("since"), "entity_sk")
    sources = spark.createDataFrame([(7, "A")], "source_sk long, code string")
    got = {r.k: r for r in facts.reviews(events, versions, sources, "who", "day", "system", [("2020-01-01", "OLD"), ("2020-03-01", "MID")], "NEW", "2019-06-01").collect()}
    assert {k: (r.entity_sk, r.source_sk, r.date_sk, r.scale_type) for k, r in got.items()} == {1: (10, 7, 20200101, "MID"), 2: (11, -1, 20200601, "NEW"), 3: (-1, -1, -7, "OLD"), 4: (-1, 7, 20200601, "NEW"), 5: (-1, 7, -5, "NEW"), 6: (-1, 7, -5, "NEW")}


def test_salaries_and_applications(spark):
    versions = spark.createDataFrame([("p", 10)], "who string, entity_sk long").withColumn("since", F.to_timestamp(F.lit("2020-01-01")))
    events = spark.createDataFrame([("p", "2020-02-01", "A", "12.5"), ("p", "2020-02-01", "A", "12,5"), ("p", "2020-02-01", "A", None)], "who string, day string, system string, pay string")
    sources = spark.createDataFrame([(7, "A")], "source_sk long, code string")
    assert sorted((r.base_salary or 0, r.salary_changes) for r in facts.salary_changes(events, versions, sources, "who", "day", "system", "pay", "2019-01-01").collect()) == [(0, 1), (0, 1), (12.5, 1)]
    asked = spark.createDataFrame([(1, "q1", "p", "2020-01-05", "2020-01-20", "2020-02-01", True), (2, "q9", None, "2020-01-05", None, None, None)], "k int, requisition_id string, who string, a string, o string, h string, yes boolean")
    known = spark.createDataFrame([("q1", 3)], "requisition_id string, requisition_sk long")
    got = {r.k: (r.requisition_sk, r.entity_sk, r.date_sk_application, r.date_sk_offer, r.date_sk_hire, r.offers, r.accepts, r.days_to_hire) for r in facts.applications(asked, versions, known, "who", "a", "o", "h", F.col("yes"), "2019-01-01").collect()}
    assert got == {1: (3, 10, 20200105, 20200120, 20200201, 1, 1, 27), 2: (-1, -1, 20200105, -5, -5, 0, 0, None)}
