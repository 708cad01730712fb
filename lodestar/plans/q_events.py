"""Queries: facts of reviews, salaries and applications with their keys, and answers traced to source rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.operators import facts, provenance
from lodestar.plans.q_facts import _AS_OF, _ENTITY, _version_keys
from lodestar.plans.q_rows import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


START = "1992-06-01"
SYSTEMS = [(1, "CORE"), (2, "LEGACY")]
_SYSTEMS = ", ".join(map(str, SYSTEMS))
_SYSTEM = "CASE o_orderstatus WHEN 'F' THEN 'CORE' WHEN 'P' THEN 'LEGACY' ELSE 'ELSEWHERE' END"


def _key(day: str) -> str:
    return f"CAST(CASE WHEN {day} IS NULL THEN {dates.NO_DATE} WHEN {day} < '{START}' THEN -7 ELSE CAST(replace({day}, '-', '') AS BIGINT) END AS BIGINT)"


def _sources(spark):
    return spark.createDataFrame(SYSTEMS, "source_sk long, code string")


def _events(spark, d):
    system = F.expr(_SYSTEM)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", dates.iso(F.col("o_orderdate")).alias("day"), system.alias("system"), F.concat_ws("|", system, F.lit("orders"), F.col("o_orderkey").cast("string")).alias("source_row_id"))


@query(f"""WITH {_ENTITY}, x AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, {_SYSTEM} AS system FROM orders)
SELECT x.o_orderkey, x.o_custkey, coalesce(e.entity_sk, -1) AS entity_sk, CAST(coalesce(s.sk, -1) AS BIGINT) AS source_sk, {_key("x.day")} AS date_sk, strftime(x.o_orderdate, '%Y') || '-H' || CASE WHEN month(x.o_orderdate) <= 6 THEN '1' ELSE '2' END AS review_cycle,
  x.o_orderpriority AS rating, CASE WHEN x.day < '1996-01-01' THEN 'NUMERIC' WHEN x.day < '1998-01-01' THEN 'LETTER' ELSE 'TEXT' END AS scale_type, 1 AS reviews, x.system || '|orders|' || x.o_orderkey AS source_row_id
FROM x {_AS_OF} LEFT JOIN (VALUES {_SYSTEMS}) s(sk, code) ON x.system = s.code
""")
def fact_performance(spark, d):
    """Orders as reviews: the version of the day, the source, the cycle and the scale in force."""
    rows = facts.reviews(_events(spark, d), _version_keys(spark, d), _sources(spark), "o_custkey", "day", "system", [("1996-01-01", "NUMERIC"), ("1998-01-01", "LETTER")], "TEXT", START)
    return rows.select("o_orderkey", "o_custkey", "entity_sk", "source_sk", "date_sk", dates.half_of(F.col("o_orderdate")).alias("review_cycle"), F.col("o_orderpriority").alias("rating"), "scale_type", "reviews", "source_row_id")


_SALARY = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not given' WHEN o_orderpriority = '5-LOW' THEN '' ELSE {} || '.5' END"


@query(f"""WITH {_ENTITY}, x AS (SELECT orders.*, n_name, strftime(o_orderdate, '%Y-%m-%d') AS day, {_SYSTEM} AS system, {_SALARY.format("CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)")} AS salary FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_regionkey = 2)
SELECT x.o_orderkey, x.o_custkey, coalesce(e.entity_sk, -1) AS entity_sk, CAST(coalesce(s.sk, -1) AS BIGINT) AS source_sk, {_key("x.day")} AS date_sk, TRY_CAST(x.salary AS DOUBLE) AS base_salary, x.n_name AS currency, x.o_orderpriority AS reason, 1 AS salary_changes, x.system || '|orders|' || x.o_orderkey AS source_row_id
FROM x {_AS_OF} LEFT JOIN (VALUES {_SYSTEMS}) s(sk, code) ON x.system = s.code
""")
def fact_compensation(spark, d):
    """Orders of two regions' customers as salary changes: text that is no number is null, each in its nation's currency."""
    nations = table(spark, d, "nation").where("n_regionkey IN (1, 2)")
    people = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    salary = F.expr(_SALARY.format("CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"))
    events = _events(spark, d).join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("salary", salary)
    rows = facts.salary_changes(events, _version_keys(spark, d), _sources(spark), "o_custkey", "day", "system", "salary", START)
    return rows.select("o_orderkey", "o_custkey", "entity_sk", "source_sk", "date_sk", "base_salary", F.col("n_name").alias("currency"), F.col("o_orderpriority").alias("reason"), "salary_changes", "source_row_id")


@query(f"""WITH {_ENTITY}, r AS (SELECT o_orderkey, o_custkey AS customer, o_orderdate, CAST(o_orderkey * 10 AS BIGINT) AS requisition_sk FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, strftime(o.o_orderdate, '%Y-%m-%d') AS applied, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS offered,
  CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN strftime(l_shipdate, '%Y-%m-%d') END AS hired, CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' AND l_linenumber = 1 THEN o.o_custkey END AS o_custkey FROM lineitem LEFT JOIN orders o ON l_orderkey = o.o_orderkey),
x AS (SELECT p.*, hired AS day FROM p)
SELECT x.l_orderkey, x.l_linenumber, coalesce(r.requisition_sk, -1) AS requisition_sk, coalesce(e.entity_sk, -1) AS entity_sk, {_key("x.applied")} AS date_sk_application, {_key("x.offered")} AS date_sk_offer, {_key("x.hired")} AS date_sk_hire,
  1 AS applications, CASE WHEN x.offered IS NOT NULL THEN 1 ELSE 0 END AS offers, CASE WHEN x.l_linestatus = 'F' AND x.l_returnflag <> 'R' THEN 1 ELSE 0 END AS accepts, CAST(datediff('day', CAST(x.applied AS DATE), CAST(x.hired AS DATE)) AS INTEGER) AS days_to_hire
FROM x {_AS_OF} LEFT JOIN r ON x.l_orderkey = r.o_orderkey
""")
def fact_application_keys(spark, d):
    """Lines as applications to orders: the first line's candidate becomes the customer on the day of hire, all others stay unknown."""
    orders = table(spark, d, "orders")
    known = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("requisition_id"), (F.col("o_orderkey") * 10).alias("requisition_sk"))
    offered = F.col("l_linestatus") == "F"
    accepted = offered & (F.col("l_returnflag") != "R")
    lines = table(spark, d, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("__c"), "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    shipped = dates.iso(F.col("l_shipdate"))
    events = lines.select(
        F.col("l_orderkey").alias("requisition_id"), "l_orderkey", "l_linenumber", accepted.alias("accepted"), dates.iso(F.col("o_orderdate")).alias("applied"), F.when(offered, shipped).alias("offered"),
        F.when(accepted, shipped).alias("hired"), F.when(accepted & (F.col("l_linenumber") == 1), F.col("__c")).alias("o_custkey"),
    )
    rows = facts.applications(events, _version_keys(spark, d), known, "o_custkey", "applied", "offered", "hired", F.col("accepted"), START)
    return rows.select("l_orderkey", "l_linenumber", "requisition_sk", "entity_sk", "date_sk_application", "date_sk_offer", "date_sk_hire", "applications", "offers", "accepts", "days_to_hire")


_SHOWN = """f AS (SELECT o_orderpriority AS level, strftime(o_orderdate, '%Y') AS year, o_totalprice AS price, 'CORE|orders|' || o_orderkey AS row_id FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT level, year, sum(price) AS answered, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 30),
g AS (SELECT 'CORE|orders|' || l_orderkey AS row_id, 'RULE_' || l_returnflag AS rule FROM lineitem WHERE l_discount >= 0.08),
l AS (SELECT row_id, count(*) AS changes, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM g GROUP BY 1),
t AS (SELECT f.level, f.year, f.row_id, f.price, coalesce(changes, 0) AS changes, coalesce(rules, '') AS rules FROM f JOIN a ON f.level IS NOT DISTINCT FROM a.level AND f.year IS NOT DISTINCT FROM a.year LEFT JOIN l ON f.row_id = l.row_id)"""


def _traced(spark, d):
    row_id = lambda c: F.concat(F.lit("CORE|orders|"), F.col(c).cast("string")).alias("row_id")
    found = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("level"), dates.year_of(F.col("o_orderdate")).alias("year"), F.col("o_totalprice").alias("price"), row_id("o_orderkey"))
    answer = found.groupBy("level", "year").agg(F.sum("price").alias("answered"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    log = table(spark, d, "lineitem").where("l_discount >= 0.08").select(row_id("l_orderkey"), F.concat(F.lit("RULE_"), F.col("l_returnflag")).alias("rule"))
    return answer, provenance.rows_behind(answer, found, ["level", "year"], "row_id", "price", log)


@query(f"WITH {_SHOWN} SELECT * FROM t")
def trace_source_rows(spark, d):
    """The source rows behind the shown sums by level and year, and the changes that were made to each."""
    return _traced(spark, d)[1]


@query(f"""WITH {_SHOWN}, s AS (SELECT level, year, sum(price) AS traced, count(*) AS "rows", count(*) FILTER (changes > 0) AS changed FROM t GROUP BY 1, 2)
SELECT a.level, a.year, round(answered, 2) AS answered, round(traced, 2) AS traced, s."rows", s.changed, true AS agrees FROM a JOIN s ON a.level IS NOT DISTINCT FROM s.level AND a.year IS NOT DISTINCT FROM s.year
""")
def trace_sums(spark, d):
    """Each shown sum against the rows traced for it."""
    answer, traced = _traced(spark, d)
    told = provenance.explained(answer, traced, ["level", "year"], "answered", "price")
    return told.withColumns({"answered": F.round("answered", 2), "traced": F.round("traced", 2)})
