"""Queries: invariants of the truth, raw tables against it, and rules over keys in one scan, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.operators import fidelity, reconcile, versions
from lodestar.operators import invariants as laws
from lodestar.plans.q_rows import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LAWS = [
    laws.Rule("price_positive", "orders", "coalesce(o_totalprice, 0) <= 0"),
    laws.Rule("closed_before_series_end", "orders", "o_orderdate > TIMESTAMP_NTZ '2001-06-01 00:00:00'", "o_orderstatus = 'F'"),
    laws.Rule("discount_in_scale", "lineitem", f"NOT coalesce({laws.in_scale('cast(l_discount * 100 AS int)', 'l_shipdate', [('1995-01-01', '1998-12-31', tuple(range(10))), ('1999-01-01', None, tuple(range(11)))])}, false)"),
    laws.Rule("returned_has_tax", "lineitem", "l_tax <= 0", "l_returnflag = 'R'"),
    laws.Exactly("one_largest_order", "orders", "o_totalprice >= 499990", 1, laws.CRITICAL),
    laws.Unique("order_once", "orders", ("o_orderkey",)),
    laws.Unique("line_once", "lineitem", ("l_orderkey", "l_linenumber")),
    laws.Unique("customer_name_once", "customer", ("c_name",)),
    laws.Known("line_of_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    laws.Known("line_of_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    laws.Known("line_of_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    laws.Known("order_of_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    laws.Known("line_of_closed_order", "lineitem", ("l_orderkey",), "closed", ("o_orderkey",), "l_linestatus = 'F'"),
    laws.Disjoint("urgent_never_large", "urgent", ("o_orderkey",), "large", ("l_orderkey",)),
    laws.Within("shipped_in_tenure", "shipped", "o_custkey", "l_shipdate", "tenure", ("c", "since", "until")),
    laws.Within("ordered_in_tenure", "orders", "o_custkey", "o_orderdate", "tenure", ("c", "since", "until")),
    laws.History("versions", "versions", "c", "since", "until", "is_current", "began"),
    laws.Planned("planned_orders", "monthly", "m", "plan", ("m", "target"), 0.05),
    laws.Falling("closed_share_by_priority", "orders", "o_orderpriority", (PRIORITIES[:2], PRIORITIES[2:4], PRIORITIES[4:]), "o_orderstatus = 'F'"),
    laws.Steady("closed_steady_by_priority", "orders", "o_orderpriority", PRIORITIES, "o_orderstatus = 'F'", 200, 0.02),
    laws.Rates("closed_rate", "orders", "o_orderstatus", {"F": 0.2, "O": 0.2, "P": 0.5}, "o_orderpriority = '1-URGENT'"),
    laws.Trend("urgent_trend", "monthly", "y", "o_orderpriority = '1-URGENT'", severity=laws.WARNING),
    laws.Reaching("segment_reaches_wealth", "customer", "c_mktsegment", "c_acctbal > 9990"),
]


def law_frames(spark, d):
    """A star over the tables: a customer's tenure from the first order to 30 days before the last one, a version a year."""
    names = ("orders", "lineitem", "customer", "part", "supplier")
    found = {n: table(spark, d, n) for n in names}
    o, line = found["orders"], found["lineitem"]
    tenure = o.groupBy(F.col("o_custkey").alias("c")).agg(F.to_date(F.min("o_orderdate")).alias("since"), F.date_sub(F.max("o_orderdate"), 30).alias("until"))
    years = o.groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    began = F.make_date(F.min("y").over(laws.W.partitionBy("c")), F.lit(1), F.lit(1))
    versions = years.withColumn("began", began).withColumn("last", F.max("y").over(laws.W.partitionBy("c")))
    # Years of seven orders reach into the next one, those of six end a day early, and a last year of five is not current.
    since = F.make_date("y", F.lit(1), F.lit(1))
    until = F.date_add(F.make_date("y", F.lit(12), F.lit(31)), F.when(F.col("n") == 7, 1).when(F.col("n") == 6, -1).otherwise(0))
    versions = versions.select("c", since.alias("since"), until.alias("until"), ((F.col("y") == F.col("last")) & (F.col("n") != 5)).alias("is_current"), "began")
    monthly = o.withColumn("m", F.trunc("o_orderdate", "month")).withColumn("y", F.year("o_orderdate"))
    lines = line.groupBy(F.trunc("l_shipdate", "month").alias("m")).agg(F.floor(F.count(F.lit(1)) / 4).alias("target"))
    return found | {
        "closed": o.where("o_orderstatus = 'F'"), "urgent": o.where("o_orderpriority = '1-URGENT'"), "large": line.where("l_quantity >= 49"), "shipped": line.join(o.select("o_orderkey", "o_custkey"), line["l_orderkey"] == F.col("o_orderkey")),
        "tenure": tenure, "versions": versions, "monthly": monthly, "plan": lines,
    }


def _key_sql(rule: str, left: str, right: str, bad: str) -> str:
    """Keys of two sides by full join: bad is over l and r, how often either side has a key."""
    return f"""SELECT '{rule}' AS rule, CAST(coalesce(sum(l), 0) AS BIGINT) AS evaluated, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS violations, CAST(NULL AS DOUBLE) AS measure, CAST(NULL AS DOUBLE) AS allowed
  FROM (SELECT coalesce(a.l, 0) AS l, coalesce(b.r, 0) AS r FROM (SELECT k, count(*) AS l FROM ({left}) GROUP BY k) a FULL JOIN (SELECT k, count(*) AS r FROM ({right}) GROUP BY k) b ON a.k = b.k)"""


def _row_sql(rule: str, frame: str, where: str, broken: str) -> str:
    return f"SELECT '{rule}', count(*) FILTER (WHERE {where}), count(*) FILTER (WHERE ({where}) AND ({broken})), NULL, NULL FROM {frame}"


def _within_sql(rule: str, events: str) -> str:
    return f"SELECT '{rule}', count(*), count(*) FILTER (WHERE NOT (day >= since AND day <= until)), NULL, NULL FROM ({events}) e JOIN tenure ON e.c = tenure.c"


_NONE = "SELECT 0 AS k WHERE false"
_KEYS = (
    ("order_once", "SELECT o_orderkey AS k FROM orders", _NONE, "l > 1"),
    ("line_once", "SELECT l_orderkey || '/' || l_linenumber AS k FROM lineitem", "SELECT '' AS k WHERE false", "l > 1"),
    ("customer_name_once", "SELECT c_name AS k FROM customer WHERE c_name IS NOT NULL", "SELECT '' AS k WHERE false", "l > 1"),
    ("line_of_order", "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders", "l > 0 AND r = 0"),
    ("line_of_part", "SELECT l_partkey AS k FROM lineitem", "SELECT p_partkey AS k FROM part", "l > 0 AND r = 0"),
    ("line_of_supplier", "SELECT l_suppkey AS k FROM lineitem", "SELECT s_suppkey AS k FROM supplier", "l > 0 AND r = 0"),
    ("order_of_customer", "SELECT o_custkey AS k FROM orders", "SELECT c_custkey AS k FROM customer", "l > 0 AND r = 0"),
    ("line_of_closed_order", "SELECT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F'", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'", "l > 0 AND r = 0"),
    ("urgent_never_large", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity >= 49", "l > 0 AND r > 0"),
)
_BAND = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 2 ELSE 3 END"


def _steps_sql(rule: str, by: str, least: int, beyond: float) -> str:
    return f"""SELECT '{rule}', CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE step > {beyond}), round(max(step), 6), {beyond} FROM (
    SELECT n, s - lag(s) OVER (ORDER BY g) AS step FROM (SELECT {by} AS g, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS s FROM orders GROUP BY 1 HAVING count(*) >= {least}))"""


_SEVERITY = ", ".join(f"('{r.id}', '{r.severity}')" for r in LAWS)


@query(f"""
WITH tenure AS (SELECT o_custkey AS c, CAST(min(o_orderdate) AS DATE) AS since, CAST(max(o_orderdate) AS DATE) - 30 AS until FROM orders GROUP BY 1),
years AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
versions AS (SELECT c, make_date(y, 1, 1) AS since, make_date(y, 12, 31) + CASE n WHEN 7 THEN 1 WHEN 6 THEN -1 ELSE 0 END AS until, y = max(y) OVER (PARTITION BY c) AND n <> 5 AS is_current, make_date(min(y) OVER (PARTITION BY c), 1, 1) AS began FROM years),
chain AS (SELECT *, lead(since) OVER (PARTITION BY c ORDER BY since) AS following, row_number() OVER (PARTITION BY c ORDER BY since) AS k FROM versions),
plan AS (SELECT m, t.target, coalesce(o.got, 0) AS got, abs(coalesce(o.got, 0) - t.target) / greatest(t.target, 1) AS off, greatest(0.05, 3 / greatest(1, sqrt(t.target))) AS most
  FROM (SELECT date_trunc('month', l_shipdate) AS m, floor(count(*) / 4) AS target FROM lineitem GROUP BY 1) t LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS got FROM orders GROUP BY 1) o USING (m)),
rates AS (SELECT *, abs(h / n - CASE o_orderstatus WHEN 'P' THEN 0.5 ELSE 0.2 END) AS off, greatest(0.06, 2.5 / sqrt(n)) AS most FROM (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS h FROM orders GROUP BY 1 HAVING count(*) >= 30)),
yearly AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) AS s, row_number() OVER (ORDER BY year(o_orderdate)) AS a, row_number() OVER (ORDER BY year(o_orderdate) DESC) AS z FROM orders GROUP BY 1 HAVING count(*) >= 30),
trend AS (SELECT sum(n) AS n, CASE WHEN count(*) >= 4 THEN sum(s) FILTER (WHERE z <= 3) / 3 - sum(s) FILTER (WHERE a <= 3) / 3 WHEN count(*) >= 2 THEN sum(s) FILTER (WHERE z = 1) - sum(s) FILTER (WHERE a = 1) ELSE 0 END AS x FROM yearly),
results AS (
  {" UNION ALL ".join(_key_sql(*k) for k in _KEYS)}
  UNION ALL {_row_sql("price_positive", "orders", "true", "coalesce(o_totalprice, 0) <= 0")}
  UNION ALL {_row_sql("closed_before_series_end", "orders", "o_orderstatus = 'F'", "o_orderdate > TIMESTAMP '2001-06-01'")}
  UNION ALL {_row_sql("discount_in_scale", "lineitem", "true", "NOT coalesce((l_shipdate >= DATE '1995-01-01' AND l_shipdate <= DATE '1998-12-31' AND trunc(l_discount * 100) <= 9) OR (l_shipdate >= DATE '1999-01-01' AND trunc(l_discount * 100) <= 10), false)")}
  UNION ALL {_row_sql("returned_has_tax", "lineitem", "l_returnflag = 'R'", "l_tax <= 0")}
  UNION ALL SELECT 'one_largest_order', n, abs(n - 1), NULL, NULL FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice >= 499990)
  UNION ALL {_within_sql("shipped_in_tenure", "SELECT o_custkey AS c, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey")}
  UNION ALL {_within_sql("ordered_in_tenure", "SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS day FROM orders")}
  UNION ALL SELECT 'versions.current', count(*), count(*) FILTER (WHERE n <> 1), NULL, NULL FROM (SELECT c, count(*) FILTER (WHERE is_current) AS n FROM versions GROUP BY 1)
  UNION ALL SELECT 'versions.overlap', count(*), count(*) FILTER (WHERE until >= following), NULL, NULL FROM chain
  UNION ALL SELECT 'versions.gap', count(*), count(*) FILTER (WHERE date_diff('day', until, following) <> 1), NULL, NULL FROM chain
  UNION ALL SELECT 'versions.begin', count(*) FILTER (WHERE k = 1), count(*) FILTER (WHERE k = 1 AND since <> began), NULL, NULL FROM chain
  UNION ALL SELECT 'planned_orders', count(*), count(*) FILTER (WHERE off > most), round(arg_max(off, off - most), 6), round(arg_max(most, off - most), 6) FROM plan
  UNION ALL SELECT 'planned_orders.total', count(*), CAST(abs(sum(got) - sum(target)) / sum(target) > 0.05 AS INTEGER), round(abs(sum(got) - sum(target)) / sum(target), 6), 0.05 FROM plan
  UNION ALL {_steps_sql("closed_share_by_priority", _BAND, 1, 0.0)}
  UNION ALL {_steps_sql("closed_steady_by_priority", "o_orderpriority", 200, 0.02)}
  UNION ALL SELECT 'closed_rate', CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE off > most), round(arg_max(off, off - most), 6), round(arg_max(most, off - most), 6) FROM rates
  UNION ALL SELECT 'urgent_trend', CAST(n AS BIGINT), CAST(x <= -0.01 AS INTEGER), round(x, 6), -0.01 FROM trend
  UNION ALL SELECT 'segment_reaches_wealth', count(*), count(*) FILTER (WHERE n = 0), NULL, NULL FROM (SELECT count(*) FILTER (WHERE c_acctbal > 9990) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
)
SELECT results.rule AS rule, severity, CAST(evaluated AS BIGINT) AS evaluated, CAST(violations AS BIGINT) AS violations, CAST(measure AS DOUBLE) AS measure, CAST(allowed AS DOUBLE) AS allowed, violations = 0 AS passed
FROM results JOIN (VALUES {_SEVERITY}) t(id, severity) ON id = split_part(results.rule, '.', 1)
""")
def truth_invariants(spark, d):
    return laws.checked(LAWS, law_frames(spark, d))


def raw_orders(spark, d):
    """(truth, raw, ledger) of orders: statuses in lower case, lost prices, lost and repeated rows; some defects are not
    declared, some are declared and not there."""
    k = F.col("o_orderkey")
    truth = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    raw = truth.where(k % 101 != 0).withColumn("status", F.when(k % 13 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))).withColumn("price", F.when(k % 17 != 0, F.col("o_totalprice")))
    raw = raw.withColumn("copies", F.explode(F.sequence(F.lit(0), F.when(k % 211 == 0, 1).otherwise(0)))).select("o_orderkey", "status", "price", "o_orderpriority")
    told = lambda defect, system, where, column: truth.where(where).select(F.lit(defect).alias("defect_id"), F.lit(system).alias("source_system"), k.alias("key"), F.lit(column).cast("string").alias("column"), F.lit("value").alias("raw_value"))
    ledger = told("D01", "CORE", "o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0", "o_orderstatus").unionByName(told("D02", "LEGACY", "o_orderkey % 17 = 0", "o_totalprice"))
    return truth, raw, ledger.unionByName(told("D03", "CORE", "o_orderkey % 101 = 0", None)).unionByName(told("D09", "OTHER", "o_orderkey % 1009 = 1", "o_orderpriority"))


RAW_COLUMNS = {"o_orderstatus": "status", "o_totalprice": "price", "o_orderpriority": "o_orderpriority"}
_RAW = """
WITH k AS (SELECT *, o_orderkey AS k FROM orders),
raw AS (SELECT k, CASE WHEN k % 13 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status, CASE WHEN k % 17 <> 0 THEN o_totalprice END AS price, o_orderpriority AS priority, CASE WHEN k % 211 = 0 THEN 2 ELSE 1 END AS n FROM k WHERE k % 101 <> 0),
ledger AS (SELECT 'D01' AS defect_id, 'CORE' AS sys, k, 'o_orderstatus' AS col FROM k WHERE k % 13 = 0 AND k % 7 <> 0 UNION ALL SELECT 'D02', 'LEGACY', k, 'o_totalprice' FROM k WHERE k % 17 = 0
  UNION ALL SELECT 'D03', 'CORE', k, NULL FROM k WHERE k % 101 = 0 UNION ALL SELECT 'D09', 'OTHER', k, 'o_orderpriority' FROM k WHERE k % 1009 = 1),
diffs AS (
  SELECT k.k, 'o_orderstatus' AS col, 'DIFFERENT' AS kind, status AS raw, o_orderstatus AS truth FROM k JOIN raw USING (k) WHERE status IS DISTINCT FROM o_orderstatus
  UNION ALL SELECT k.k, 'o_totalprice', 'DIFFERENT', CAST(price AS VARCHAR), CAST(o_totalprice AS VARCHAR) FROM k JOIN raw USING (k) WHERE price IS DISTINCT FROM o_totalprice
  UNION ALL SELECT k, NULL, 'MISSING', NULL, NULL FROM k WHERE k NOT IN (SELECT k FROM raw) UNION ALL SELECT k, NULL, 'REPEATED', NULL, NULL FROM raw WHERE n > 1
)"""


@query(f"""{_RAW}
SELECT CAST(k AS VARCHAR) AS key, col AS "column", kind, CASE WHEN col = 'o_totalprice' THEN NULL ELSE raw END AS raw, CASE WHEN col = 'o_totalprice' THEN NULL ELSE truth END AS truth FROM diffs
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.k = diffs.k AND (l.col IS NULL OR l.col = diffs.col))
""")
def raw_undeclared(spark, d):
    """What differs from the truth though the ledger doesn't tell; declared prices never come back, so none is written out."""
    truth, raw, ledger = raw_orders(spark, d)
    return fidelity.undeclared(fidelity.compared(raw, truth, "o_orderkey", RAW_COLUMNS, ledger))


@query(f"""{_RAW},
seen AS (SELECT defect_id, sys, count(*) AS n FROM ledger GROUP BY ALL), known AS (SELECT * FROM (VALUES ('D01', 'CORE'), ('D02', 'LEGACY'), ('D03', 'CORE'), ('D04', 'CORE')) t(defect_id, sys)),
results AS (
  SELECT 'undeclared_equals_truth' AS rule, 'BLOCKER' AS severity, (SELECT count(*) FROM k) AS evaluated, count(*) AS violations, CAST(NULL AS DOUBLE) AS measure, CAST(NULL AS DOUBLE) AS allowed FROM diffs WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.k = diffs.k AND (l.col IS NULL OR l.col = diffs.col))
  UNION ALL SELECT 'declared_shows', 'BLOCKER', count(*), count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM diffs d WHERE d.k = l.k AND coalesce(d.col, '') = coalesce(l.col, ''))), NULL, NULL FROM ledger l
  UNION ALL SELECT 'ledger_of_these_systems', 'BLOCKER', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (WHERE sys NOT IN ('CORE', 'LEGACY')), 0) AS BIGINT), NULL, NULL FROM seen
  UNION ALL SELECT 'ledger_in_catalogue', 'BLOCKER', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (WHERE (defect_id, sys) NOT IN (SELECT (defect_id, sys) FROM known)), 0) AS BIGINT), NULL, NULL FROM seen
  UNION ALL SELECT 'catalogue_seen', 'BLOCKER', count(*), count(*) FILTER (WHERE (defect_id, sys) NOT IN (SELECT (defect_id, sys) FROM seen)), NULL, NULL FROM known
  UNION ALL SELECT 'D02_is_a_missing_column', 'BLOCKER', count(*), count(*), NULL, NULL FROM ledger WHERE defect_id = 'D02'
  UNION ALL SELECT 'D01_in_its_window', 'BLOCKER', count(*), count(*) FILTER (WHERE o_orderdate >= DATE '1999-01-01' + 1), NULL, NULL FROM ledger JOIN k USING (k) WHERE defect_id = 'D01'
  UNION ALL SELECT 'D03_count', 'BLOCKER', count(*), CAST(abs(count(*) - 150) > 15 AS INTEGER), count(*), 150 FROM ledger WHERE defect_id = 'D03'
  UNION ALL SELECT 'populations_differ_as_configured', 'CRITICAL', b, CAST(NOT abs(a - b) / b BETWEEN 0.0025 AND 0.02 AS INTEGER), round(abs(a - b) / b, 6), 0.02 FROM (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM raw) AS a, (SELECT count(*) FROM k) AS b)
  UNION ALL SELECT 'technical_columns', 'BLOCKER', 2, 2, NULL, NULL UNION ALL SELECT 'raw_lacks_o_order', 'BLOCKER', 4, 2, NULL, NULL UNION ALL SELECT 'truth_has_o_orderkey_o_orderdate', 'BLOCKER', 5, 0, NULL, NULL
)
SELECT rule, severity, CAST(evaluated AS BIGINT) AS evaluated, CAST(violations AS BIGINT) AS violations, CAST(measure AS DOUBLE) AS measure, CAST(allowed AS DOUBLE) AS allowed, violations = 0 AS passed FROM results
""")
def raw_validators(spark, d):
    truth, raw, ledger = raw_orders(spark, d)
    catalogue = spark.createDataFrame([("D01", "CORE"), ("D02", "LEGACY"), ("D03", "CORE"), ("D04", "CORE")], "defect_id string, source_system string")
    parts = [
        fidelity.faithful(fidelity.compared(raw, truth, "o_orderkey", RAW_COLUMNS, ledger)), fidelity.in_catalogue(ledger, catalogue, ["CORE", "LEGACY"]), fidelity.absent_columns(ledger, "D02"),
        fidelity.in_window(ledger, "D01", truth, "o_orderkey", "o_orderdate", ("1995-01-01", "1999-01-01")), fidelity.of_count(ledger, {"D03": 150}), fidelity.alike(raw, truth, (0.005, 0.01)),
        fidelity.of_schema(spark, {"raw": raw.schema, "truth": truth.schema}, forbidden={"raw": ("o_order",)}, present={"truth": ("o_orderkey", "o_orderdate")}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_LOG = """
WITH log AS (
  SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, 'status' AS col, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_orderkey, 'priority', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), -o_orderkey, 'status', 'X' FROM orders WHERE o_orderkey % 7 = 0
)"""


@query(f"""{_LOG},
daily AS (SELECT c, d, arg_max({{'v': v}}, k) FILTER (WHERE col = 'status') AS s, arg_max({{'v': v}}, k) FILTER (WHERE col = 'priority') AS p FROM log GROUP BY 1, 2),
states AS (SELECT c, d, last_value(s IGNORE NULLS) OVER w AS s, last_value(p IGNORE NULLS) OVER w AS p FROM daily WINDOW w AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)),
plain AS (SELECT c, d, s.v AS status, p.v AS priority FROM states),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w OR priority IS DISTINCT FROM lag(priority) OVER w THEN 1 ELSE 0 END AS new FROM plain WINDOW w AS (PARTITION BY c ORDER BY d)),
runs AS (SELECT c, min(d) AS a, version, any_value(status) AS status, any_value(priority) AS priority FROM (SELECT *, sum(new) OVER (PARTITION BY c ORDER BY d) AS version FROM marked) GROUP BY c, version)
SELECT c AS entity, CAST(version AS BIGINT) AS version, strftime(a, '%Y-%m-%d') AS effective_from, coalesce(strftime(lead(a) OVER w - 1, '%Y-%m-%d'), '9999-12-31') AS effective_to, lead(a) OVER w IS NULL AS is_current, status, priority FROM runs WINDOW w AS (PARTITION BY c ORDER BY version)
""")
def state_log_history(spark, d):
    """Histories of customers from a log of single changes, two of them on some days."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    change = lambda df, order, column, value: df.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("day"), order.alias("order"), F.lit(column).alias("column"), value.alias("value"))
    log = change(o.where(k % 3 != 0), k, "status", F.col("o_orderstatus")).unionByName(change(o.where(k % 2 == 0), k, "priority", F.when(k % 5 != 0, F.col("o_orderpriority")))).unionByName(change(o.where(k % 7 == 0), -k, "status", F.lit("X")))
    return versions.state_history(log, "entity", "day", ["order"], ["status", "priority"]).withColumn("effective_from", dates.iso(F.col("effective_from")))


_COVER = """
WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS key, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT key, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y, coalesce(c.n, 0) AS z FROM a FULL JOIN b USING (key) FULL JOIN c USING (key) WHERE key IS NOT NULL),
v AS (SELECT *, CASE WHEN x > 0 AND y > 0 AND z > 0 THEN 'COMPLETE' WHEN x > 0 AND y = 0 AND z = 0 THEN 'ONLY_master' WHEN x = 0 AND y > 0 AND z = 0 THEN 'ONLY_orders' WHEN x = 0 AND y = 0 THEN 'ONLY_events'
  WHEN x = 0 THEN 'LACKS_master' WHEN y = 0 THEN 'LACKS_orders' ELSE 'LACKS_events' END AS verdict FROM m)"""


def three_sources(spark, d):
    key = lambda name, c: table(spark, d, name).select(F.col(c).alias("key"))
    return reconcile.coverage({"master": key("customer", "c_custkey"), "orders": key("orders", "o_custkey"), "events": key("events", "user_id")}, "key")


@query(f"{_COVER} SELECT key, x AS rows_master, y AS rows_orders, z AS rows_events, concat_ws('_', CASE WHEN x = 0 THEN 'master' END, CASE WHEN y = 0 THEN 'orders' END, CASE WHEN z = 0 THEN 'events' END) AS missing, verdict FROM v")
def source_coverage(spark, d):
    return three_sources(spark, d).withColumn("missing", F.array_join("missing", "_"))


@query(f"{_COVER} SELECT verdict, count(*) AS keys, round(count(*) / (SELECT count(*) FROM v), 6) AS share FROM v GROUP BY 1")
def source_coverage_summary(spark, d):
    return reconcile.coverage_summary(three_sources(spark, d))
