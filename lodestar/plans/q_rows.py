"""Queries: sources, filters, projections, joins, set operations and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import dates, keys, similarity, text
from lodestar.operators import lookups, nearest, profile, quality, reconcile, standardize
from lodestar.session import ship
from lodestar.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority,
       'shop|orders|' || row_number() OVER (ORDER BY o_orderkey) AS _row_id FROM orders
""")
def scan_staged_text(spark, d):
    rows = readers.as_text(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return readers.with_row_id(rows, "shop", "orders", "o_orderkey")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def scan_nested_split(spark, d):
    return readers.json_fields(table(spark, d, "events").select("event_id", "event_type", "props"), "props", ["k"]).drop("props")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 30")
def scope_filter(spark, d):
    rows = quality.scoped(table(spark, d, "lineitem"), {"column": "l_returnflag", "in": ["A", "R"]})
    return quality.scoped(rows, {"column": "l_quantity", "min": 10, "max": 30}).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN -1 WHEN 1 THEN NULL WHEN 2 THEN -4 WHEN 3 THEN 999 ELSE c_nationkey END AS k FROM customer)
SELECT c_custkey, CASE WHEN k = -1 THEN 'UNKNOWN' WHEN k = -4 THEN 'NOT_APPLICABLE' WHEN k IS NULL OR n_name IS NULL THEN 'MISSING' ELSE n_name END AS member
FROM c LEFT JOIN nation ON k = n_nationkey
""")
def sentinel_project(spark, d):
    digit = F.col("c_custkey") % 10
    k = F.when(digit == 0, -1).when(digit == 1, None).when(digit == 2, -4).when(digit == 3, 999).otherwise(F.col("c_nationkey"))
    rows = table(spark, d, "customer").select("c_custkey", k.alias("k"))
    rows = rows.join(lookups.small(table(spark, d, "nation")), F.col("k") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", keys.member_or_code(F.col("k"), F.col("n_name"), {-1: "UNKNOWN", -4: "NOT_APPLICABLE"}).alias("member"))


def _dirty_date():
    k = F.col("o_orderkey")
    return F.when(k % 17 == 0, "").when(k % 19 == 0, "31/02/2019").when(k % 23 == 0, None).otherwise(dates.iso(F.col("o_orderdate")))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN '31/02/2019' WHEN o_orderkey % 23 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS x FROM orders),
p AS (SELECT o_orderkey, CAST(try_strptime(x, '%Y-%m-%d') AS DATE) AS v FROM t)
SELECT o_orderkey, CAST(CASE WHEN v IS NULL THEN -5 WHEN v < DATE '1996-01-01' THEN -7 ELSE CAST(strftime(v, '%Y%m%d') AS BIGINT) END AS BIGINT) AS date_sk FROM p
""")
def date_key_sentinel(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.date_key(_dirty_date(), "1996-01-01").alias("date_sk"))


@query("""
WITH o AS (SELECT o_custkey, min(o_orderdate) AS first_order, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ACQUIRED' WHEN first_order < TIMESTAMP '1995-03-01' THEN 'LEGACY' WHEN urgent = 1 THEN 'HIRED' ELSE 'UNDETERMINED' END AS code,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'P1' WHEN first_order < TIMESTAMP '1995-03-01' THEN 'P2' WHEN urgent = 1 THEN 'P3' ELSE 'NONE' END AS rule
FROM customer LEFT JOIN o ON c_custkey = o_custkey
""")
def provenance_rules(spark, d):
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    rows = table(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    told = reconcile.first_rule([("P1", "ACQUIRED", F.col("c_mktsegment") == "MACHINERY"), ("P2", "LEGACY", F.col("first_order") < F.lit("1995-03-01").cast("timestamp_ntz")), ("P3", "HIRED", F.col("urgent"))])
    return rows.select("c_custkey", told.alias("t")).select("c_custkey", "t.*")


_RECORD = [("F", "1995-01-01", "1997-12-31"), ("O", "1998-01-01", "2000-12-31")]


@query("""
SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1997-12-31')
       OR (o_orderstatus = 'O' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1998-01-01' AND '2000-12-31') AS of_record FROM orders
""")
def sor_filter(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", dates.in_windows(F.col("o_orderstatus"), dates.iso(F.col("o_orderdate")), _RECORD).alias("of_record"))


@query("""
SELECT r_name, n_name, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2
""")
def join_equi_star(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # Aggregated by nation before the two small joins.
    by_nation = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    named = by_nation.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.sum("v").cast("double").alias("revenue"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 999 ELSE c_nationkey END AS k FROM customer)
SELECT c_custkey, CAST(coalesce(n_nationkey, -1) AS BIGINT) AS nation_sk FROM c LEFT JOIN nation ON k = n_nationkey
""")
def join_left_reserved(spark, d):
    k = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 13 == 0, 999).otherwise(F.col("c_nationkey"))
    rows = table(spark, d, "customer").select("c_custkey", k.alias("k"))
    return lookups.key_or(rows, table(spark, d, "nation"), [("k", "n_nationkey")], "n_nationkey", "nation_sk", -1).drop("k")


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS mapped FROM orders),
l AS (SELECT '1-URGENT' AS code, 10 AS sk UNION ALL SELECT '2-HIGH', 20)
SELECT o_orderkey, CAST(coalesce(sk, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN -2 ELSE -1 END) AS BIGINT) AS level_sk FROM o LEFT JOIN l ON mapped = code
""")
def join_level_pending(spark, d):
    p = F.col("o_orderpriority")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(p.isin("1-URGENT", "2-HIGH"), p).alias("mapped"))
    levels = spark.createDataFrame([("1-URGENT", 10), ("2-HIGH", 20)], "code string, sk int")
    return lookups.level_key(rows, levels, "mapped", "o_orderpriority", ["4-NOT SPECIFIED"], "level_sk").select("o_orderkey", "level_sk")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-06-01')")
def join_semi(spark, d):
    recent = table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")))
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-06-01')")
def join_anti(spark, d):
    recent = table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")))
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT e.event_id, e.user_id, s.signup_id FROM events e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def join_asof_version(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    signups = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"))
    return lookups.as_of(events.select("event_id", "user_id", "ts"), signups, "user_id", "ts", "since", ["signup_id"], "day").select("event_id", "user_id", "signup_id")


#: source value, standard value, id, status, from, to.
PRIORITY_MAPPING = (
    ("1-URGENT", "HIGH", "M1", "APPROVED", "", "1997-12-31"),
    ("1-URGENT", "TOP", "M2", "APPROVED", "1998-01-01", ""),
    ("2-High", "HIGH", "M3", "APPROVED", "", ""),
    ("3-MEDIUM", "MID", "M4", "APPROVED", "1996-01-01", "1999-12-31"),
    ("3-MEDIUM", "MIDDLE", "M5", "APPROVED", "1999-01-01", "2000-12-31"),
    ("5-LOW", "LOW", "M6", "PROPOSED", "", ""),
)
MAPPING_VALUES = ", ".join(str((*row, k)) for k, row in enumerate(PRIORITY_MAPPING))
MAPPED_SQL = f"""
m AS (SELECT * FROM (VALUES {MAPPING_VALUES}) t(source_value, standard_value, mapping_id, mapping_status, valid_from, valid_to, ordinal) WHERE mapping_status = 'APPROVED'),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
j AS (SELECT o.*, m.standard_value, m.mapping_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY m.ordinal NULLS LAST) AS k
      FROM o LEFT JOIN m ON lower(priority) = lower(source_value) AND ((day IS NULL AND valid_to = '') OR ((valid_from = '' OR day >= valid_from) AND (valid_to = '' OR day <= valid_to)))),
mapped AS (SELECT o_orderkey, priority, day, CASE WHEN priority IS NOT NULL THEN coalesce(standard_value, 'UNMAPPED') END AS std_priority, mapping_id AS std_priority__mapping_id FROM j WHERE k = 1)
"""


def mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, k) for k, row in enumerate(PRIORITY_MAPPING)], "source_value string, standard_value string, mapping_id string, mapping_status string, valid_from string, valid_to string, ordinal int")


def mapped_orders(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.operators import mapping

    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 31 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 29 != 0, dates.iso(F.col("o_orderdate"))).alias("day"))
    return mapping.mapped(rows, mapping_table(spark), "priority", "day", "priority")


@query(f"WITH {MAPPED_SQL} SELECT o_orderkey, std_priority, std_priority__mapping_id FROM mapped")
def join_interval_mapping(spark, d):
    return mapped_orders(spark, d).select("o_orderkey", "std_priority", "std_priority__mapping_id")


@query("""
WITH v AS (SELECT DISTINCT lower(substr(p_name, 1, 9)) AS value FROM part), t AS (SELECT DISTINCT lower(p_name) AS target FROM part),
s AS (SELECT value, target, -levenshtein(value, target) AS score FROM v, t)
SELECT value, target, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY value ORDER BY score DESC, target) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, target) <= 3
""")
def join_fuzzy_rank(spark, d):
    names = table(spark, d, "part").select(F.lower("p_name").alias("target")).distinct()
    values = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 9)).alias("value"))
    best = nearest.nearest(values, names, "value", "target", 3, (-F.levenshtein("value", "target")).cast("bigint"), nearest.distance_rounds(values, names, "value", "target"))
    return best.select("value", "target", "score", "rank")


@query()
def mapping_candidates(spark, d):
    """The exact scorers: best two standard values of each cut or spaced product name. SQL lacks the matched share; tests hold
    the whole table against every pair by plain loops."""
    ship(spark)
    part = table(spark, d, "part")
    texts = part.select("p_name", F.explode(F.array(F.col("p_name"), F.regexp_replace("p_name", r"^(\S+) .*$", "$1"))).alias("target"))
    values = part.select(F.regexp_replace(F.substring("p_name", 1, 7), " ", ". ").alias("value"))
    scored = nearest.nearest(values, texts, "value", "target", 2, similarity.similarity(F.col("value"), F.col("target"))["score"], nearest.SHARE_ROUNDS, "p_name")
    best = scored.withColumn("method", similarity.similarity(F.col("value"), F.col("via"))["method"])
    return best.select("value", "target", F.round("score", 9).alias("score"), "method", "via", "rank")


@query("""
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier
""")
def union_by_name_relaxed(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def distinct_subset(spark, d):
    """One row of each pair, the one of the least key: a grouped minimum instead of an arbitrary row."""
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def set_minus(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").distinct().join(gone, "p_partkey", "left_anti")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40")
def set_intersect(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 40 AND l_returnflag IN ('A', 'R')")
    both = lines.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "A").alias("a"), F.max(F.col("l_returnflag") == "R").alias("r"))
    return both.where("a AND r").select("l_partkey")


def _dirty_text(c):
    k = F.col("c_custkey") % 6
    return F.when(k == 0, F.concat(F.lit("  "), c, F.lit(" "))).when(k == 1, F.concat(c, F.lit("   x\t\tx"))).when(k == 2, "").when(k == 3, None).when(k == 4, "   ").otherwise(c)


_DIRTY_SQL = "CASE c_custkey % 6 WHEN 0 THEN '  ' || c_mktsegment || ' ' WHEN 1 THEN c_mktsegment || '   x' || chr(9) || chr(9) || 'x' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '   ' ELSE c_mktsegment END"


@query(f"WITH t AS (SELECT c_custkey, {_DIRTY_SQL} AS x FROM customer) SELECT c_custkey, regexp_replace(regexp_replace(nullif(x, ''), '^\\s+|\\s+$', '', 'g'), '\\s{{2,}}', ' ', 'g') AS segment FROM t")
def std_chain(spark, d):
    from lodestar.specs import StandardSpec

    rows = table(spark, d, "customer").select("c_custkey", _dirty_text(F.col("c_mktsegment")).alias("segment"))
    return standardize.standardized(rows, StandardSpec(), 2024)


@query(f"""
WITH t AS (SELECT c_custkey, {_DIRTY_SQL} AS x FROM customer), e AS (SELECT c_custkey, x, nullif(x, '') AS a FROM t),
f AS (SELECT *, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS b FROM e), g AS (SELECT *, regexp_replace(b, '\\s{{2,}}', ' ', 'g') AS c FROM f)
SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'segment' AS "column", 'EMPTY_TO_NULL' AS rule, x AS old, a AS new FROM g WHERE x IS DISTINCT FROM a
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', 'TRIM', a, b FROM g WHERE a IS DISTINCT FROM b
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', 'COLLAPSE', b, c FROM g WHERE b IS DISTINCT FROM c
""")
def std_change_log(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_row_id"), _dirty_text(F.col("c_mktsegment")).alias("segment"))
    return standardize.change_log(rows, ["segment"])


def _mixed_dates():
    k, t = F.col("o_orderkey") % 8, F.col("o_orderdate")
    return (
        F.when(k == 0, "31/02/2019").when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, dates.iso(t)).when(k == 3, "").when(k == 4, None).when(k == 5, "1930-05-01")
        .when(k == 6, F.concat(F.dayofmonth(t).cast("string"), F.lit("/"), F.month(t).cast("string"), F.lit("/"), F.year(t).cast("string"))).otherwise("15/06/85")
    )


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '31/02/2019' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '1930-05-01'
       WHEN 6 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) ELSE '15/06/85' END AS x FROM orders),
p AS (SELECT o_orderkey, x, list_filter([CASE WHEN x <> '15/06/85' THEN CAST(try_strptime(x, '%d/%m/%Y') AS DATE) END, CAST(try_strptime(x, '%Y-%m-%d') AS DATE), CASE WHEN x <> '15/06/85' THEN CAST(try_strptime(x, '%m/%d/%Y') AS DATE) END,
       CASE WHEN x = '15/06/85' THEN DATE '1985-06-15' END], lambda v: v IS NOT NULL) AS c FROM t),
q AS (SELECT o_orderkey, x, c[1] AS v, len(list_distinct(c)) > 1 AS ambiguous FROM p)
SELECT o_orderkey, CASE WHEN year(v) BETWEEN 1950 AND 2025 THEN strftime(v, '%Y-%m-%d') END AS iso,
       CASE WHEN x IS NULL OR x = '' THEN 'empty' WHEN v IS NULL THEN 'unknown_format' WHEN year(v) NOT BETWEEN 1950 AND 2025 THEN 'out_of_window' ELSE 'ok' END AS parse, coalesce(ambiguous, false) AS ambiguous FROM q
""")
def std_dates(spark, d):
    parsed = dates.parsed_date(_mixed_dates(), "d/M/yyyy", 2024)
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.*")


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || ',50' WHEN 1 THEN o_orderkey || '.25' WHEN 2 THEN '1.234,56' WHEN 3 THEN 'n/a' WHEN 4 THEN '' ELSE NULL END AS x FROM orders)
SELECT k AS o_orderkey, CASE k % 6 WHEN 0 THEN k + 0.5::DOUBLE WHEN 1 THEN k + 0.25::DOUBLE WHEN 2 THEN 1234.56::DOUBLE END AS num,
       CASE WHEN x IS NULL OR x = '' THEN 'empty' WHEN x = 'n/a' THEN 'not_numeric' ELSE 'ok' END AS parse FROM t
""")
def std_decimals(spark, d):
    k = F.col("o_orderkey")
    x = F.when(k % 6 == 0, F.concat(k.cast("string"), F.lit(",50"))).when(k % 6 == 1, F.concat(k.cast("string"), F.lit(".25"))).when(k % 6 == 2, "1.234,56").when(k % 6 == 3, "n/a").when(k % 6 == 4, "")
    return table(spark, d, "orders").select("o_orderkey", text.parsed_decimal(x).alias("p")).select("o_orderkey", "p.*")


@query("SELECT p_partkey, trim(regexp_replace(replace(replace(lower(strip_accents('São ' || p_name || '. & Ção')), '.', ' '), '&', ' e '), '\\s+', ' ', 'g')) AS key FROM part")
def norm_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normal_key(F.concat(F.lit("São "), F.col("p_name"), F.lit(". & Ção"))).alias("key"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, datediff('month', o_orderdate, l_shipdate) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def month_diff(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", dates.month_boundaries(F.col("o_orderdate"), F.col("l_shipdate")).alias("months"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, datediff('day', o_orderdate, l_shipdate) AS days, CAST(round(datediff('day', o_orderdate, l_shipdate) / CAST(30.44 AS DOUBLE), 2) AS DOUBLE) AS tenure
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def tenure_days(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"), dates.tenure_months(F.col("o_orderdate"), F.col("l_shipdate")).alias("tenure"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'São José' ELSE 'Ação ' || c_name END AS name FROM customer")
def mojibake_repair(spark, d):
    good = F.when(F.col("c_custkey") % 2 == 0, F.lit("São José")).otherwise(F.concat(F.lit("Ação "), F.col("c_name")))
    broken = F.when(F.col("c_custkey") % 3 != 0, F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")).otherwise(good)
    return table(spark, d, "customer").select("c_custkey", text.repaired_encoding(broken).alias("name"))


_REDACT_SQL = "text"
for _pattern, _mark in text.REDACTIONS:
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT doc_id, md5({_REDACT_SQL}) AS redacted_md5, {_REDACT_SQL} <> text AS has_personal_data FROM documents")
def redact_pii(spark, d):
    clean = table(spark, d, "documents").select("doc_id", "text", text.redacted(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("redacted_md5"), (F.col("clean") != F.col("text")).alias("has_personal_data"))


@query()
def redact_names(spark, d):
    """Structural patterns first, then names. SQL has no look-up of allowed runs; tests hold the whole table against plain loops."""
    ship(spark)
    clean = table(spark, d, "documents").select("doc_id", "text", text.without_names(text.redacted(F.col("text")), ("Apache License", "Customer Service"), ("the", "in", "of")).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("redacted_md5"), (F.col("clean") != F.col("text")).alias("has_personal_data"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents('Ção-' || p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', ' ', 'g')) AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS number FROM part")
def slug_and_number(spark, d):
    k = F.col("p_partkey")
    coded = F.when(k % 3 == 0, F.concat(F.lit("WD00"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("XX"), k.cast("string"))).otherwise(F.concat(F.lit("WD"), k.cast("string"), F.lit("b")))
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat(F.lit("Ção-"), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), text.extracted_number(coded, "WD").alias("number"))



_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count(x) AS nulls, CAST(round(1 - count(x) / count(*), 6) AS DOUBLE) AS null_rate, count(DISTINCT x) AS distinct_values, min(length(x)) AS min_length, max(length(x)) AS max_length, """
    + ", ".join(f"CAST(round(avg(CASE WHEN regexp_matches(x, '{p}') THEN 1.0 WHEN x IS NULL THEN NULL ELSE 0.0 END), 6) AS DOUBLE) AS {k}" for k, p in profile.PATTERNS.items())
    + f" FROM (SELECT CAST({c} AS VARCHAR) AS x FROM orders)"
    for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")
)


@query(_PROFILE)
def profile_columns(spark, d):
    return profile.profiled(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT * FROM (VALUES ('o_orderstatus', 'SMALL_DOMAIN'), ('o_orderpriority', 'SMALL_DOMAIN')) t(\"column\", finding)")
def profile_findings(spark, d):
    return profile.findings(profile.profiled(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


@query("""
WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5
""")
def topk_values(spark, d):
    return profile.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])
