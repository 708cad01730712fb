"""Queries: histories, dimensions and facts, data quality, mapping, identity, trust and reconciliation, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import dates, keys
from lodestar.operators import identity, lookups, mapping, quality, reconcile, trust, versions
from lodestar.plans.q_rows import MAPPED_SQL, mapped_orders, table
from lodestar.specs import Check

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


ISLANDS = """
o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS k,
  CASE WHEN row_number() OVER w = 1 OR lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus OR lag(o_orderpriority) OVER w IS DISTINCT FROM o_orderpriority THEN 1 ELSE 0 END AS fresh
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS version FROM o),
v AS (SELECT o_custkey, CAST(version AS BIGINT) AS version, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(*) AS observations, arg_max(o_orderstatus, k) AS o_orderstatus, arg_max(o_orderpriority, k) AS o_orderpriority FROM i GROUP BY 1, 2),
c AS (SELECT *, lead(first_day) OVER (PARTITION BY o_custkey ORDER BY first_day, version) AS following FROM v),
s AS (SELECT o_custkey, version, strftime(first_day, '%Y-%m-%d') AS effective_from, strftime(last_day, '%Y-%m-%d') AS last_seen, observations, o_orderstatus, o_orderpriority,
  CASE WHEN following IS NULL THEN '9999-12-31' ELSE strftime(CAST(following AS DATE) - 1, '%Y-%m-%d') END AS effective_to, following IS NULL AS is_current FROM c)
"""


def customer_versions(spark, d):
    rows = versions.islands(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    shut = versions.closed(rows, "o_custkey")
    return shut.withColumn("effective_from", dates.iso(F.col("effective_from"))).withColumn("last_seen", dates.iso(F.col("last_seen")))


@query(f"WITH {ISLANDS} SELECT * FROM s")
def win_islands_scd2(spark, d):
    return customer_versions(spark, d)


@query(f"""WITH {ISLANDS}, m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, min(o_orderpriority) AS t FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2)
SELECT s.o_custkey, s.version, CASE WHEN s.version = 1 THEN 'ENTRY' ELSE coalesce(m.t, 'OBSERVED') END AS change_reason FROM s LEFT JOIN m ON s.o_custkey = m.o_custkey AND substr(s.effective_from, 1, 7) = m.month
""")
def scd2_change_reason(spark, d):
    moves = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_custkey", F.col("o_orderdate").alias("movement_date"), F.col("o_orderpriority").alias("movement_type"))
    return versions.with_reasons(customer_versions(spark, d), moves, "o_custkey").select("o_custkey", "version", "change_reason")


@query(f"""WITH {ISLANDS}, f AS (SELECT o_custkey, effective_to, lead(effective_from) OVER (PARTITION BY o_custkey ORDER BY effective_from) AS following FROM s)
SELECT o_custkey, CASE WHEN following <= effective_to THEN 'OVERLAP' ELSE 'GAP' END AS fault FROM f WHERE following <= effective_to OR datediff('day', CAST(effective_to AS DATE), CAST(following AS DATE)) > 1
UNION SELECT o_custkey, 'NOT_ONE_CURRENT' FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE is_current) <> 1
""")
def scd2_faults(spark, d):
    return versions.history_faults(customer_versions(spark, d), "o_custkey")


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS customer_sk FROM customer")
def win_row_surrogate(spark, d):
    return keys.numbered(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "customer_sk")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate, o_orderkey) = 1")
def win_keep_first(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return versions.first_by(table(spark, d, "orders"), ["o_custkey"], [rank, "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), g AS (SELECT o_custkey, m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m) AS gap FROM m)
SELECT o_custkey, max(gap) AS longest_gap FROM g GROUP BY 1
""")
def win_month_gap(spark, d):
    m = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate").cast("bigint") * 12 + F.month("o_orderdate")).alias("m")).distinct()
    gap = F.col("m") - F.lag("m").over(W.partitionBy("o_custkey").orderBy("m"))
    return m.withColumn("gap", gap).groupBy("o_custkey").agg(F.max("gap").alias("longest_gap"))


CALENDAR_SQL = """
SELECT strftime(x, '%Y-%m-%d') AS date_iso, CAST(strftime(x, '%Y%m%d') AS BIGINT) AS date_sk, CAST(year(x) AS INTEGER) AS "year", strftime(x, '%Y-%m') AS "month", CAST(month(x) AS INTEGER) AS month_number, CAST(day(x) AS INTEGER) AS "day",
  year(x) || '-Q' || quarter(x) AS "quarter", year(x) || '-H' || CASE WHEN month(x) <= 6 THEN 1 ELSE 2 END AS "half", last_day(x) = x AS is_month_end, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = x) AS "rows"
FROM (SELECT CAST(unnest(generate_series((SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) FROM orders), (SELECT CAST(date_trunc('year', max(o_orderdate)) AS DATE) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY)) AS DATE) AS x)
"""


@query(f"""WITH c AS ({CALENDAR_SQL}) SELECT "month", max(date_iso) FILTER (WHERE is_month_end) AS month_end, max(date_iso) FILTER (WHERE "rows" > 0) AS last_order_day, CAST(sum("rows") AS BIGINT) AS "rows" FROM c GROUP BY 1""")
def win_month_end(spark, d):
    """Of each month of the orders' years its end, the last day with an order, and the orders."""
    days = versions.calendar_of(table(spark, d, "orders"), "o_orderdate")
    return days.groupBy("month").agg(F.max(F.when(F.col("is_month_end"), F.col("date_iso"))).alias("month_end"), F.max(F.when(F.col("rows") > 0, F.col("date_iso"))).alias("last_order_day"), F.sum("rows").alias("rows"))


@query(f"{CALENDAR_SQL} UNION ALL SELECT NULL, -5, NULL, 'NO_DATE', NULL, NULL, NULL, NULL, NULL, NULL UNION ALL SELECT NULL, -7, NULL, 'BEFORE_SERIES', NULL, NULL, NULL, NULL, NULL, NULL")
def dim_calendar(spark, d):
    days = versions.calendar_of(table(spark, d, "orders"), "o_orderdate")
    return days.unionByName(keys.reserved_rows(days, [{"date_sk": dates.NO_DATE, "month": "NO_DATE"}, {"date_sk": dates.BEFORE_SERIES, "month": "BEFORE_SERIES"}]))


@query("""
WITH o AS (SELECT n_name, c_mktsegment, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, c_mktsegment, o_orderpriority, min(m) AS valid_from, CASE WHEN max(m) = (SELECT max(m) FROM o) THEN '9999-12-31' ELSE max(m) END AS valid_to FROM o GROUP BY 1, 2, 3
""")
def dim_organization(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return versions.observed_combinations(rows.withColumn("m", dates.month_of(F.col("o_orderdate"))), ["n_name", "c_mktsegment", "o_orderpriority"], "m")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 3 = 1 THEN 'cross_reference' ELSE 'unresolved' END AS basis,
  CASE WHEN c_custkey % 3 = 2 THEN 'SRC:shop:' || c_name ELSE 'ID:' || c_custkey END AS entity_key, c_custkey % 3 = 2 AS provisional FROM customer
""")
def entity_keys(spark, d):
    k = F.col("c_custkey")
    made = keys.entity_key(F.when(k % 3 == 0, k), F.when(k % 3 == 1, k), F.lit("shop"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", made.alias("e")).select("c_custkey", "e.*")


@query(f"""WITH {ISLANDS}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT o_custkey, effective_from, max(version) AS version FROM s GROUP BY 1, 2),
b AS (SELECT f.*, e.version FROM f ASOF LEFT JOIN e ON f.o_custkey = e.o_custkey AND f.day >= e.effective_from)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(version, -1) AS version, CAST(CASE WHEN day < '1996-01-01' THEN -7 ELSE CAST(replace(day, '-', '') AS BIGINT) END AS BIGINT) AS date_sk, CAST(coalesce(s_suppkey, -6) AS BIGINT) AS source_sk, 1 AS lines,
  (l_linestatus = 'F' AND day BETWEEN '1995-01-01' AND '1998-12-31') OR (l_linestatus = 'O' AND day BETWEEN '1999-01-01' AND '2003-12-31') AS of_record
FROM b LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 <> 0
""")
def fact_snapshot(spark, d):
    """Shipped lines with the customer version of their day, date and source keys, and whether the source was of record."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "o_custkey", dates.iso(F.col("l_shipdate")).alias("day"), F.col("l_shipdate").cast("timestamp").alias("at"))
    known = customer_versions(spark, d).select("o_custkey", F.col("effective_from").cast("timestamp").alias("since"), "version")
    rows = lookups.as_of(rows, known, "o_custkey", "at", "since", ["version"], "quarter")
    rows = lookups.key_or(rows, table(spark, d, "supplier").where("s_suppkey % 7 <> 0"), [("l_suppkey", "s_suppkey")], "s_suppkey", "source_sk", -6)
    record = dates.in_windows(F.col("l_linestatus"), F.col("day"), [("F", "1995-01-01", "1998-12-31"), ("O", "1999-01-01", "2003-12-31")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("version", F.lit(-1)).alias("version"), dates.date_key(F.col("day"), "1996-01-01").alias("date_sk"), "source_sk", F.lit(1).alias("lines"), record.alias("of_record"))


@query("""
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS returned FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS opened_sk, CAST(coalesce(CAST(strftime(first_ship, '%Y%m%d') AS BIGINT), -5) AS BIGINT) AS shipped_sk, CAST(coalesce(CAST(strftime(returned, '%Y%m%d') AS BIGINT), -5) AS BIGINT) AS returned_sk,
  CAST(datediff('day', o_orderdate, first_ship) AS INTEGER) AS days_to_ship, CASE WHEN returned IS NOT NULL THEN 1 ELSE 0 END AS was_returned FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def fact_requisition(spark, d):
    """An accumulating snapshot: one row an order, a date key for each step, NO_DATE where it was not reached."""
    steps = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"))
    rows = table(spark, d, "orders").join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = lambda c: dates.date_key(dates.iso(F.col(c)), "1990-01-01")
    return rows.select("o_orderkey", key("o_orderdate").alias("opened_sk"), key("first_ship").alias("shipped_sk"), key("returned").alias("returned_sk"), F.datediff("first_ship", "o_orderdate").alias("days_to_ship"), F.col("returned").isNotNull().cast("int").alias("was_returned"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority, o_custkey, o_orderdate, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
k AS (SELECT * FROM (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('5-LOW', 1)) t(code, rank))
SELECT o_orderkey, before AS from_level, o_orderpriority AS to_level, CAST(b.rank - a.rank AS INTEGER) AS level_delta FROM r LEFT JOIN k a ON before = a.code LEFT JOIN k b ON o_orderpriority = b.code WHERE before IS NOT NULL AND before <> o_orderpriority
""")
def fact_movement(spark, d):
    """Changes of level from a customer's one order to the next, with the ranks' difference where both are ranked."""
    rank = spark.createDataFrame([("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("5-LOW", 1)], "code string, rank int")
    before = F.lag("o_orderpriority").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").select("o_orderkey", before.alias("from_level"), F.col("o_orderpriority").alias("to_level")).where("from_level <> to_level")
    side = lambda k: lookups.small(rank.select(F.col("code").alias(f"{k}_level"), F.col("rank").alias(k)))
    return rows.join(side("from"), "from_level", "left").join(side("to"), "to_level", "left").select("o_orderkey", "from_level", "to_level", (F.col("to") - F.col("from")).alias("level_delta"))


def _dq(spark, d, checks, frames=("orders", "customer", "lineitem")):
    found = {n: table(spark, d, n) for n in frames}
    if "orders" in found:
        o = found["orders"]
        k = F.col("o_orderkey")
        found["orders"] = o.select(
            "*", dates.iso(F.col("o_orderdate")).alias("day"), F.when(k % 37 == 0, None).when(k % 41 == 0, " N/A ").otherwise(F.col("o_orderpriority")).alias("level"),
            F.when(k % 43 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("customer"), F.when(k % 53 == 0, k - k % 106).otherwise(k).alias("number"), F.date_format("o_orderdate", "yyyy").alias("year"),
            F.when(k % 59 == 0, "1980-01-01").otherwise(dates.iso(F.date_add("o_orderdate", 10))).alias("due"),
        )
    return quality.run(checks, found)


DIRTY_ORDERS = """
d AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS "day", CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN ' N/A ' ELSE o_orderpriority END AS level, CASE WHEN o_orderkey % 43 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer,
  CASE WHEN o_orderkey % 53 = 0 THEN o_orderkey - o_orderkey % 106 ELSE o_orderkey END AS number, strftime(o_orderdate, '%Y') AS "year", CASE WHEN o_orderkey % 59 = 0 THEN '1980-01-01' ELSE strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') END AS due FROM orders)
"""


def _dq_sql(rows: list[tuple[str, str, str, float, str, str]], more: str = "") -> str:
    """rows: id, severity, finding, most, SQL of evaluated, SQL of failed."""
    parts = " UNION ALL ".join(f"SELECT '{i}' AS check_id, '{s}' AS severity, '{f}' AS finding, {m} AS most, CAST(({e}) AS BIGINT) AS evaluated, CAST(({x}) AS BIGINT) AS failed" for i, s, f, m, e, x in rows)
    return f"""WITH {DIRTY_ORDERS}{more}, r AS ({parts}) SELECT check_id, severity, finding, coalesce(evaluated, 0) AS evaluated, coalesce(failed, 0) AS failed, CAST(round(failed / nullif(evaluated, 0), 6) AS DOUBLE) AS rate,
      CASE WHEN coalesce(evaluated, 0) = 0 THEN 'NOT_RUN' WHEN failed / evaluated <= most THEN 'PASS' ELSE 'FAIL' END AS status FROM r"""


_C = "CRITICAL"


@query(_dq_sql([
    ("null", "BLOCKER", "INVALID", 0.0, "SELECT count(*) FROM d", "SELECT count(*) FROM d WHERE level IS NULL"),
    ("placeholder", _C, "INVALID", 0.0, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE trim(level) IN ('N/A', '-')"),
    ("domain", _C, "UNMAPPED", 0.05, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE trim(level) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"),
    ("not_equal", "WARNING", "DECISION_PENDING", 0.0, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE level = '4-NOT SPECIFIED'"),
    ("order", "BLOCKER", "INVALID", 0.0, "SELECT count(*) FROM d WHERE \"day\" IS NOT NULL AND due IS NOT NULL", "SELECT count(*) FROM d WHERE due < \"day\""),
    ("dates", _C, "INVALID", 0.0, "SELECT count(*) FROM d WHERE due IS NOT NULL AND due <> ''", "SELECT count(*) FROM d WHERE due < '1990-01-01' OR due > '2001-06-30'"),
    ("missing_column", _C, "INVALID", 0.0, "SELECT NULL", "SELECT NULL"),
    ("scoped", _C, "INVALID", 0.0, "SELECT count(*) FROM d WHERE o_orderstatus = 'P'", "SELECT count(*) FROM d WHERE o_orderstatus = 'P' AND level IS NULL"),
]))
def dq_rowlevel(spark, d):
    return _dq(spark, d, [
        Check("null", "orders", "not_null", "level", "BLOCKER"), Check("placeholder", "orders", "not_in_set", "level", args={"values": ["N/A", "-"]}),
        Check("domain", "orders", "in_set", "level", finding="UNMAPPED", most=0.05, args={"values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}),
        Check("not_equal", "orders", "not_equal", "level", "WARNING", "DECISION_PENDING", args={"value": "4-NOT SPECIFIED"}), Check("order", "orders", "before", "day", "BLOCKER", args={"other": "due"}),
        Check("dates", "orders", "date_between", "due", args={"min": "1990-01-01", "max": "2001-06-30"}), Check("missing_column", "orders", "not_null", "no_such_column"),
        Check("scoped", "orders", "not_null", "level", scope={"column": "o_orderstatus", "equals": "P"}),
    ])


@query(_dq_sql([
    ("range", _C, "INVALID", 0.1, "SELECT count(*) FROM d", "SELECT count(*) FROM d WHERE o_totalprice < 1000 OR o_totalprice > 450000"),
    ("regex", _C, "INVALID", 0.05, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE NOT regexp_matches(level, '^[1-5]-')"),
    ("not_regex", "WARNING", "INVALID", 0.05, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE regexp_matches(level, '^ | $')"),
    ("length", "WARNING", "INVALID", 0.0, "SELECT count(level) FROM d", "SELECT count(*) FROM d WHERE length(trim(level)) < 4 OR length(trim(level)) > 12"),
    ("distinct", "INFO", "INVALID", 0.0, "SELECT count(*) FROM d", "SELECT CASE WHEN count(DISTINCT level) BETWEEN 2 AND 5 THEN 0 ELSE 1 END FROM d"),
    ("mean", "INFO", "INVALID", 0.0, "SELECT count(o_totalprice) FROM d", "SELECT CASE WHEN avg(o_totalprice) BETWEEN 1 AND 1000 THEN 0 ELSE 1 END FROM d"),
]))
def dq_range_regex(spark, d):
    return _dq(spark, d, [
        Check("range", "orders", "between", "o_totalprice", most=0.1, args={"min": 1000, "max": 450000}), Check("regex", "orders", "match", "level", most=0.05, args={"regex": "^[1-5]-"}),
        Check("not_regex", "orders", "not_match", "level", "WARNING", most=0.05, args={"regex": "^ | $"}), Check("length", "orders", "length_between", "level", "WARNING", args={"min": 4, "max": 12}),
        Check("distinct", "orders", "distinct_between", "level", "INFO", args={"min": 2, "max": 5}), Check("mean", "orders", "mean_between", "o_totalprice", "INFO", args={"min": 1, "max": 1000}),
    ])


@query(_dq_sql([
    ("unique", "BLOCKER", "INVALID", 0.0, "SELECT count(*) FROM d", "SELECT coalesce(sum(n), 0) FROM (SELECT number, count(*) AS n FROM d WHERE number IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    ("unique_ok", "BLOCKER", "INVALID", 0.0, "SELECT count(*) FROM d", "SELECT 0"),
]))
def dq_unique(spark, d):
    return _dq(spark, d, [Check("unique", "orders", "unique", "number", "BLOCKER"), Check("unique_ok", "orders", "unique", "o_orderkey", "BLOCKER")])


@query(_dq_sql([("pair", _C, "INVALID", 0.0, "SELECT count(*) FROM d", "SELECT sum(n) FROM (SELECT o_custkey, level, \"year\", count(*) AS n FROM d WHERE level IS NOT NULL GROUP BY ALL HAVING count(*) > 1)")]))
def dq_compound_unique(spark, d):
    return _dq(spark, d, [Check("pair", "orders", "compound_unique", args={"columns": ["o_custkey", "level", "year"]})])


@query(_dq_sql([
    ("reference", _C, "INVALID", 0.01, "SELECT count(customer) FROM d", "SELECT count(*) FROM d WHERE customer NOT IN (SELECT c_custkey FROM customer)"),
    ("reference_ok", _C, "INVALID", 0.0, "SELECT count(l_orderkey) FROM lineitem", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
]))
def dq_reference(spark, d):
    return _dq(spark, d, [Check("reference", "orders", "in_reference", "customer", most=0.01, args={"reference": "customer", "column": "c_custkey"}), Check("reference_ok", "lineitem", "in_reference", "l_orderkey", args={"reference": "orders", "column": "o_orderkey"})])


@query(_dq_sql([
    ("gap", _C, "STALE", 0.0, "SELECT count(DISTINCT substr(\"day\", 1, 7)) FROM d", "SELECT CASE WHEN max(g) > 1 THEN 1 ELSE 0 END FROM (SELECT m - lag(m) OVER (ORDER BY m) AS g FROM (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS m FROM d))"),
    ("gap_due", _C, "STALE", 0.0, "SELECT count(DISTINCT substr(due, 1, 7)) FROM d", "SELECT 1"),
]))
def dq_month_gap(spark, d):
    return _dq(spark, d, [Check("gap", "orders", "month_gap_below", "day", finding="STALE", args={"most": 1}), Check("gap_due", "orders", "month_gap_below", "due", finding="STALE", args={"most": 1})])


@query(_dq_sql([("months", "WARNING", "DIVERGENT", 0.1,
    "SELECT count(*) FROM (SELECT DISTINCT substr(\"day\", 1, 7) AS m FROM d) a JOIN (SELECT DISTINCT substr(due, 1, 7) AS m FROM d) b ON a.m = b.m",
    "SELECT count(*) FROM (SELECT substr(\"day\", 1, 7) AS m, count(*) AS n FROM d GROUP BY 1) a JOIN (SELECT substr(due, 1, 7) AS m, count(*) AS r FROM d GROUP BY 1) b ON a.m = b.m WHERE n / r NOT BETWEEN 0.95 AND 1.05")]))
def dq_group_ratio(spark, d):
    return _dq(spark, d, [Check("months", "orders", "group_ratio", "day", "WARNING", "DIVERGENT", 0.1, {"reference": "orders", "column": "due", "min": 0.95, "max": 1.05})])


@query(_dq_sql([
    ("rows", _C, "DIVERGENT", 0.0, "SELECT count(*) FROM d WHERE o_orderstatus = 'F'", "SELECT CASE WHEN (SELECT count(*) FROM d WHERE o_orderstatus = 'F') / (SELECT count(*) FROM customer) BETWEEN 1 AND 2 THEN 0 ELSE 1 END"),
    ("sums", _C, "DIVERGENT", 0.0, "SELECT count(*) FROM d", "SELECT CASE WHEN (SELECT sum(o_totalprice) FROM d) / (SELECT sum(l_extendedprice) FROM lineitem) BETWEEN 0.01 AND 100 THEN 0 ELSE 1 END"),
]))
def dq_row_ratio(spark, d):
    return _dq(spark, d, [
        Check("rows", "orders", "row_ratio", finding="DIVERGENT", args={"reference": "customer", "min": 1, "max": 2}, scope={"column": "o_orderstatus", "equals": "F"}),
        Check("sums", "orders", "sum_ratio", "o_totalprice", finding="DIVERGENT", args={"reference": "lineitem", "column": "l_extendedprice", "min": 0.01, "max": 100}),
    ])


@query(_dq_sql([
    ("fresh", "WARNING", "STALE", 0.0, "SELECT count(*) FROM d", "SELECT CASE WHEN max(\"day\") < '2001-01-01' THEN 1 ELSE 0 END FROM d"),
    ("stale", "WARNING", "STALE", 0.0, "SELECT count(*) FROM d", "SELECT CASE WHEN max(\"day\") < '2024-01-01' THEN 1 ELSE 0 END FROM d"),
]))
def dq_max_date(spark, d):
    return _dq(spark, d, [Check("fresh", "orders", "max_date_after", "day", "WARNING", "STALE", args={"min": "2001-01-01"}), Check("stale", "orders", "max_date_after", "day", "WARNING", "STALE", args={"min": "2024-01-01"})])


IDENTITY_SQL = """
a AS (SELECT c_custkey AS entity_id, c_mktsegment || '/' || (c_custkey % 97) AS name, CAST(c_nationkey AS VARCHAR) AS date FROM customer WHERE c_custkey % 5 <> 0),
p AS (SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 9 = 0 THEN 'nobody' ELSE c_mktsegment || '/' || (c_custkey % 97) END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS date FROM customer),
n2 AS (SELECT name, date, count(DISTINCT entity_id) AS c, min(entity_id) AS m FROM a GROUP BY 1, 2), n1 AS (SELECT name, count(DISTINCT entity_id) AS c, min(entity_id) AS m FROM a GROUP BY 1),
j AS (SELECT p.*, a.entity_id AS exact, n2.c AS c2, n2.m AS m2, n1.c AS c1, n1.m AS m1 FROM p LEFT JOIN a ON p.id = a.entity_id LEFT JOIN n2 ON p.name = n2.name AND p.date = n2.date LEFT JOIN n1 ON p.name = n1.name),
x AS (SELECT 'shop' AS source_system, source_id, CASE WHEN exact IS NOT NULL THEN exact WHEN c2 = 1 THEN m2 WHEN c2 > 1 THEN NULL WHEN c1 = 1 THEN m1 END AS entity_id,
  CASE WHEN exact IS NOT NULL THEN 'exact_id' WHEN c2 >= 1 THEN 'name_date' WHEN c1 >= 1 THEN 'name' ELSE 'none' END AS method, CAST(CASE WHEN exact IS NOT NULL THEN 1.0 WHEN c2 >= 1 THEN 0.85 WHEN c1 >= 1 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE WHEN exact IS NOT NULL THEN 'RESOLVED' WHEN c2 = 1 THEN 'MANUAL_REVIEW' WHEN c2 > 1 THEN 'AMBIGUOUS' WHEN c1 = 1 THEN 'MANUAL_REVIEW' WHEN c1 > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS match_status FROM j)
"""


def cross_reference(spark, d):
    c = table(spark, d, "customer")
    k, name = F.col("c_custkey"), F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 97).cast("string"))
    anchor = c.where(k % 5 != 0).select(k.alias("entity_id"), name.alias("name"), F.col("c_nationkey").cast("string").alias("date"))
    people = c.select(k.cast("string").alias("source_id"), F.when(k % 2 == 0, k).alias("id"), F.when(k % 9 == 0, "nobody").otherwise(name).alias("name"), F.when(k % 7 != 0, F.col("c_nationkey").cast("string")).alias("date"))
    return identity.resolved(people, anchor, "shop")


@query(f"WITH {IDENTITY_SQL} SELECT * FROM x")
def identity_cascade(spark, d):
    return cross_reference(spark, d)


@query(f"WITH {IDENTITY_SQL} SELECT match_status, method, count(*) AS n FROM x GROUP BY 1, 2")
def identity_summary(spark, d):
    return cross_reference(spark, d).groupBy("match_status", "method").agg(F.count(F.lit(1)).alias("n"))


@query(_dq_sql([
    ("identity", _C, "IDENTITY_UNRESOLVED", 0.6, "SELECT count(o_custkey) FROM d", "SELECT count(*) FROM d WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT source_id FROM x WHERE match_status = 'RESOLVED')"),
    ("other_keys", _C, "IDENTITY_UNRESOLVED", 0.0, "SELECT NULL", "SELECT NULL"),
], ", " + IDENTITY_SQL))
def dq_identity(spark, d):
    frames = {"orders": table(spark, d, "orders"), "xref": cross_reference(spark, d)}
    return quality.run([
        Check("identity", "orders", "identity_resolved", "o_custkey", finding="IDENTITY_UNRESOLVED", most=0.6, args={"reference": "xref", "system": "shop"}),
        Check("other_keys", "orders", "identity_resolved", "o_orderpriority", finding="IDENTITY_UNRESOLVED", args={"reference": "xref", "system": "shop"}),
    ], frames)


CUT_CHECKS = [
    Check("null", "orders", "not_null", "level", "BLOCKER"), Check("domain", "orders", "in_set", "level", finding="UNMAPPED", args={"values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}),
    Check("due", "orders", "before", "day", "BLOCKER", args={"other": "due"}), Check("number", "orders", "unique", "number", "BLOCKER"), Check("length", "orders", "length_between", "level", "WARNING", args={"min": 1}),
]
_CUTS = [("ALL", "true"), *((f"o_orderstatus={s}", f"o_orderstatus = '{s}'") for s in "FOP")]


def _cut_rows() -> str:
    parts = []
    for cut, where in _CUTS:
        for i, sev, fin, e, x in (
            ("null", "BLOCKER", "INVALID", "count(*)", "count(*) FILTER (WHERE level IS NULL)"),
            ("domain", _C, "UNMAPPED", "count(level)", "count(*) FILTER (WHERE trim(level) = 'N/A')"),
            ("due", "BLOCKER", "INVALID", "count(*)", "count(*) FILTER (WHERE due < \"day\")"),
            ("length", "WARNING", "INVALID", "count(level)", "0"),
        ):
            parts.append(f"SELECT '{i}' AS check_id, '{cut}' AS cut, '{sev}' AS severity, '{fin}' AS finding, CAST({e} AS BIGINT) AS evaluated, CAST({x} AS BIGINT) AS failed FROM d WHERE {where}")
        parts.append(f"SELECT 'number', '{cut}', 'BLOCKER', 'INVALID', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT number, count(*) AS n FROM d WHERE {where} GROUP BY 1)")
    return " UNION ALL ".join(parts)


CUTS_SQL = f"{DIRTY_ORDERS}, r AS ({_cut_rows()})"


def cut_results(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", dates.iso(F.col("o_orderdate")).alias("day"), F.when(k % 37 == 0, None).when(k % 41 == 0, " N/A ").otherwise(F.col("o_orderpriority")).alias("level"),
        F.when(k % 53 == 0, k - k % 106).otherwise(k).alias("number"), F.when(k % 59 == 0, "1980-01-01").otherwise(dates.iso(F.date_add("o_orderdate", 10))).alias("due"),
    )
    return quality.run(CUT_CHECKS, {"orders": o}, {"orders": ["o_orderstatus"]})


@query(f"WITH {CUTS_SQL} SELECT check_id, cut, severity, finding, evaluated, failed, CAST(round(failed / nullif(evaluated, 0), 6) AS DOUBLE) AS rate, CASE WHEN evaluated = 0 THEN 'NOT_RUN' WHEN failed / evaluated <= 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r")
def dq_cuts_grouping_sets(spark, d):
    return cut_results(spark, d)


@query(f"""WITH {CUTS_SQL}, k AS (SELECT * FROM (VALUES ('orders', 'null'), ('orders', 'domain'), ('orders', 'due'), ('orders', 'length'), ('keys', 'number'), ('keys', 'null'), ('mapping', 'domain'), ('text', 'length')) t(metric, check_id)),
w AS (SELECT metric, cut, finding, CASE WHEN severity IN ('BLOCKER', 'CRITICAL') AND evaluated > 0 THEN CAST(evaluated AS DOUBLE) END AS weight, CASE WHEN severity IN ('BLOCKER', 'CRITICAL') AND evaluated > 0 THEN least(1.0, failed / evaluated) * evaluated END AS lost FROM r JOIN k USING (check_id)),
g AS (SELECT metric, cut, count(weight) AS checks, sum(lost) / sum(weight) AS loss, sum(lost) FILTER (WHERE finding = 'INVALID') / sum(weight) AS error, sum(lost) FILTER (WHERE finding = 'INVALID') / sum(weight) FILTER (WHERE finding = 'INVALID') AS lv, sum(lost) FILTER (WHERE finding = 'UNMAPPED') / sum(weight) FILTER (WHERE finding = 'UNMAPPED') AS lc FROM w GROUP BY 1, 2),
h AS (SELECT *, coalesce(error, 0) AS e, coalesce(loss, 0) - coalesce(error, 0) AS p, greatest(0, 1 - loss) AS score FROM g)
SELECT metric, cut, checks, CASE WHEN loss IS NOT NULL THEN CAST(round(score, 6) AS DOUBLE) END AS trust_score, CASE WHEN loss IS NOT NULL THEN CAST(round(e, 6) AS DOUBLE) END AS loss_by_error, CASE WHEN loss IS NOT NULL THEN CAST(round(greatest(p, 0), 6) AS DOUBLE) END AS loss_by_pendency,
  CASE WHEN lv IS NOT NULL THEN CAST(round(greatest(0, 1 - lv), 6) AS DOUBLE) END AS validity, CASE WHEN lc IS NOT NULL THEN CAST(round(greatest(0, 1 - lc), 6) AS DOUBLE) END AS coverage, CAST(NULL AS DOUBLE) AS identity, CAST(NULL AS DOUBLE) AS timeliness,
  CASE WHEN loss IS NULL THEN 'UNDETERMINED' WHEN score >= 0.95 THEN 'CERTIFIED' WHEN score >= 0.70 OR (e < 1e-6 AND score >= 0.40) THEN 'LIMITED' ELSE 'BLOCKED' END AS status,
  CASE WHEN loss IS NULL THEN 'NO_EVIDENCE' WHEN score >= 0.95 AND e + p < 1e-9 THEN 'OK' WHEN score >= 0.95 THEN CASE WHEN e >= p THEN 'ERROR' ELSE 'PENDENCY' END WHEN score >= 0.70 THEN CASE WHEN e > p THEN 'ERROR' ELSE 'PENDENCY' END WHEN e < 1e-6 AND score >= 0.40 THEN 'PENDENCY' ELSE CASE WHEN e > p THEN 'ERROR' ELSE 'PENDENCY' END END AS reason FROM h
""")
def trust_scores(spark, d):
    depends = spark.createDataFrame([("orders", "null"), ("orders", "domain"), ("orders", "due"), ("orders", "length"), ("keys", "number"), ("keys", "null"), ("mapping", "domain"), ("text", "length")], "metric string, check_id string")
    return trust.trust(cut_results(spark, d), depends)


@query(f"""WITH {DIRTY_ORDERS}, f AS (SELECT o_orderkey AS row_id, 'null' AS check_id FROM d WHERE level IS NULL UNION ALL SELECT o_orderkey, 'due' FROM d WHERE due < "day"
  UNION ALL SELECT o_orderkey, 'number' FROM d WHERE number IN (SELECT number FROM d GROUP BY 1 HAVING count(*) > 1))
SELECT check_id, count(*) AS "rows" FROM f GROUP BY 1 UNION ALL SELECT 'APPROVED', (SELECT count(*) FROM d WHERE o_orderkey NOT IN (SELECT row_id FROM f))
""")
def quarantine_split(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", dates.iso(F.col("o_orderdate")).alias("day"), F.when(k % 37 == 0, None).when(k % 41 == 0, " N/A ").otherwise(F.col("o_orderpriority")).alias("level"),
        F.when(k % 53 == 0, k - k % 106).otherwise(k).alias("number"), F.when(k % 59 == 0, "1980-01-01").otherwise(dates.iso(F.date_add("o_orderdate", 10))).alias("due"),
    )
    good, bad = quality.quarantined(o, CUT_CHECKS, "o_orderkey")
    return bad.groupBy("check_id").agg(F.count(F.lit(1)).alias("rows")).unionByName(good.agg(F.lit("APPROVED").alias("check_id"), F.count(F.lit(1)).alias("rows")))


@query(f"WITH {MAPPED_SQL} SELECT std_priority, count(*) AS n, count(std_priority__mapping_id) AS with_id FROM mapped GROUP BY 1")
def mapping_apply(spark, d):
    return mapped_orders(spark, d).groupBy("std_priority").agg(F.count(F.lit(1)).alias("n"), F.count("std_priority__mapping_id").alias("with_id"))


@query(f"WITH {MAPPED_SQL} SELECT priority AS source_value, count(*) AS occurrences, min(day) AS first_seen, max(day) AS last_seen FROM mapped WHERE std_priority = 'UNMAPPED' GROUP BY 1")
def mapping_exceptions(spark, d):
    return mapping.exceptions(mapped_orders(spark, d), "priority", "priority", "day")


@query(f"""WITH {MAPPED_SQL}, f AS (SELECT priority AS v, count(*) AS n, min(day) AS a, max(day) AS z FROM mapped WHERE std_priority = 'UNMAPPED' GROUP BY 1),
q AS (SELECT * FROM (VALUES ('5-LOW', 'UNDER_REVIEW', '1994-01-01'), ('1-URGENT', 'APPROVED', '1993-01-01'), ('gone', 'OPEN', '1992-01-01')) t(v, status, first_seen))
SELECT coalesce(q.v, f.v) AS source_value, coalesce(status, 'OPEN') AS status, coalesce(n, 0) AS occurrences, least(q.first_seen, a) AS first_seen, z AS last_seen FROM q FULL JOIN f ON q.v = f.v WHERE n IS NOT NULL OR status IN ('APPROVED', 'REJECTED', 'UNDER_REVIEW')
""")
def mapping_queue(spark, d):
    queue = spark.createDataFrame([("5-LOW", "UNDER_REVIEW", "1994-01-01"), ("1-URGENT", "APPROVED", "1993-01-01"), ("gone", "OPEN", "1992-01-01")], "source_value string, status string, first_seen string")
    return mapping.merged_queue(queue, mapping.exceptions(mapped_orders(spark, d), "priority", "priority", "day"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS a, CAST(p_size % 10 AS DOUBLE) / 20 AS b, p_partkey % 50 = 0 AS same, p_partkey % 33 = 0 AS own, p_partkey % 4 = 0 AS other FROM part)
SELECT p_partkey, CASE WHEN own THEN 'BUSINESS_DECISION' WHEN same THEN 'SPELLING_VARIANT' WHEN a >= 0.80 AND round(a - b, 3) >= 0.12 THEN 'KNOWN_ALIAS' WHEN a >= 0.55 AND round(a - b, 3) < 0.12 AND NOT other THEN 'BUSINESS_DECISION' WHEN other THEN 'TRANSLATION_PENDING' WHEN a >= 0.55 THEN 'LIKELY_CANDIDATE' ELSE 'WEAK_CANDIDATE' END AS class FROM p
""")
def proposal_ladder(spark, d):
    k = F.col("p_partkey")
    told = mapping.proposal_class(F.col("p_size").cast("double") / 50, (F.col("p_size") % 10).cast("double") / 20, k % 50 == 0, k % 33 == 0, k % 4 == 0)
    return table(spark, d, "part").select("p_partkey", told.alias("class"))


@query(f"""WITH {MAPPED_SQL}, t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MID' ELSE 'LOW' END AS truth FROM orders),
b AS (SELECT std_priority, truth FROM mapped JOIN t USING (o_orderkey))
SELECT count(*) AS "rows", count(*) FILTER (WHERE std_priority = truth) AS recovered, count(*) FILTER (WHERE std_priority = 'UNMAPPED') AS unmapped, count(*) FILTER (WHERE coalesce(std_priority, '') NOT IN (truth, 'UNMAPPED')) AS divergent, CAST(round(count(*) FILTER (WHERE std_priority = truth) / count(*), 6) AS DOUBLE) AS recovered_rate FROM b
""")
def reconcile_truth(spark, d):
    p = F.col("o_orderpriority")
    truth = table(spark, d, "orders").select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), "HIGH").when(p == "3-MEDIUM", "MID").otherwise("LOW").alias("truth"))
    return reconcile.recovery(mapped_orders(spark, d), truth, "o_orderkey", "std_priority", "truth")


@query("""
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT a.month, a.n AS ours, b.n AS theirs, CAST(round((a.n - b.n) / b.n, 6) AS DOUBLE) AS deviation FROM a JOIN b ON a.month = b.month
""")
def reconcile_months(spark, d):
    monthly = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(dates.month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.monthly_deviation(monthly("F"), monthly("O"))


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 100 = 7 THEN c_custkey - c_custkey % 100 + 3 WHEN c_custkey % 100 = 3 THEN c_custkey - c_custkey % 100 + 7 WHEN c_custkey = 0 THEN NULL ELSE c_custkey // 2 END AS p FROM customer),
w AS (SELECT n AS a, p AS b, 1 AS k FROM e WHERE p IS NOT NULL UNION SELECT a, p, k + 1 FROM w JOIN e ON b = n WHERE p IS NOT NULL AND k < 40) SELECT DISTINCT a AS node FROM w WHERE a = b
""")
def hierarchy_cycle(spark, d):
    k = F.col("c_custkey")
    parent = F.when(k % 100 == 7, k - k % 100 + 3).when(k % 100 == 3, k - k % 100 + 7).when(k == 0, None).otherwise(F.floor(k / 2))
    return reconcile.cycles(spark, table(spark, d, "customer").select(k.alias("n"), parent.alias("p")), "n", "p")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 300 > 0 THEN c_custkey - 1 WHEN c_custkey % 600 = 0 THEN c_custkey + 3 END AS p FROM customer),
w AS (SELECT n AS a, p AS b FROM e WHERE p IS NOT NULL UNION SELECT a, p FROM w JOIN e ON b = n WHERE p IS NOT NULL) SELECT DISTINCT a AS node FROM w WHERE a = b
""")
def hierarchy_cycle_deep(spark, d):
    """Chains of 300, every other one with a cycle of four at its end."""
    k = F.col("c_custkey")
    parent = F.when(k % 300 > 0, k - 1).when(k % 600 == 0, k + 3)
    return reconcile.cycles(spark, table(spark, d, "customer").select(k.alias("n"), parent.alias("p")), "n", "p")


#: Columns of each table: i number, s text, d fraction, t time, a array of fractions.
_COLUMNS = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
_AS_SQL = {"i": "CAST({c} AS VARCHAR)", "s": "{c}", "d": "printf('%.6f', CAST({c} AS DOUBLE))", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')", "a": "array_to_string(list_transform({c}, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')"}


def _hash_sql(name: str) -> str:
    kinds = dict(c.split(":") for c in _COLUMNS[name].split())
    row = ", ".join("coalesce(" + _AS_SQL[kinds[c]].format(c=c) + ", '?')" for c in sorted(kinds))
    return f"SELECT '{name}' AS \"table\", count(*) AS \"rows\", {len(kinds)} AS columns, CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {row})), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS hash FROM {name}"


@query(" UNION ALL ".join(map(_hash_sql, _COLUMNS)))
def content_hash(spark, d):
    """Rows, columns and an order-free hash of each table."""
    hashes = [reconcile.content_hash(table(spark, d, name)).select(F.lit(name).alias("table"), "*") for name in _COLUMNS]
    return reduce(DataFrame.unionByName, hashes)
