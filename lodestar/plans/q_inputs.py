"""Queries: normalised masters and events with their persons, origins, the summary of a build, ordered queues, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestar.functions import dates, text
from lodestar.operators import inputs, mapping, quality
from lodestar.plans.q_model import MAPPED_SQL, mapped_orders
from lodestar.plans.q_rows import table
from lodestar.specs import Check, InputSpec

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


SERIES_START = "1992-07-01"
SPECS = [
    InputSpec("CORE", "customer", "id", (("name", "c_name"), ("unit", "c_mktsegment"), ("country", "c_nationkey"), ("start", "start")), "own_id", "row_id"),
    InputSpec("ACQUIRED", "customer", "id", (("name", "c_name"), ("unit", "c_mktsegment"), ("country", "c_nationkey"), ("start", None)), None, "row_id"),
    InputSpec("LEGACY", "supplier", "s_suppkey", (("name", "s_name"), ("unit", "division"), ("country", "s_nationkey"), ("start", None)), None, "row_id"),
    InputSpec("AGENCY", "workers", "id", (("name", "name"),)),
]


def _frames(spark, d):
    customer, k = table(spark, d, "customer"), F.col("c_custkey")
    row_id = lambda system, dataset, c: F.concat_ws("|", F.lit(system), F.lit(dataset), c.cast("string")).alias("row_id")
    start = F.when(k % 11 != 0, dates.iso(F.date_add(F.lit("1992-01-01").cast("date"), (k % 365).cast("int")))).alias("start")
    own = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "").alias("own_id")
    return {
        ("CORE", "customer"): customer.select(F.concat(F.lit("C"), k.cast("string")).alias("id"), own, "c_name", "c_mktsegment", "c_nationkey", start, row_id("CORE", "customer", k)),
        ("ACQUIRED", "customer"): customer.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("A"), k.cast("string")).alias("id"), "c_name", "c_mktsegment", "c_nationkey", row_id("ACQUIRED", "customer", k)),
        ("LEGACY", "supplier"): table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", row_id("LEGACY", "supplier", F.col("s_suppkey"))),
    }


def _xref(spark, d):
    """One source's links need a decision, one's are decided for every second person, and candidates of the shop are known by their orders."""
    customer, k, s = table(spark, d, "customer"), F.col("c_custkey"), F.col("s_suppkey")
    link = lambda system, i, entity, sure: (F.lit(system).alias("source_system"), i.alias("source_id"), entity.cast("string").alias("entity_id"), F.when(sure, "RESOLVED").otherwise("MANUAL_REVIEW").alias("match_status"), F.when(sure, 1.0).otherwise(0.85).alias("confidence"))
    parts = [
        customer.where("c_custkey % 3 <> 0").select(*link("CORE", F.concat(F.lit("C"), k.cast("string")), k, k % 3 == 1)),
        customer.where("c_custkey % 3 <> 0").select(*link("CORE", F.concat(F.lit("C"), k.cast("string")), k + 500_000, F.lit(False))),
        customer.select(*link("ACQUIRED", F.concat(F.lit("A"), k.cast("string")), k, k % 2 == 0)),
        table(spark, d, "supplier").where("s_suppkey % 4 = 1").select(*link("LEGACY", s.cast("string"), s + 1_000_000, F.lit(True))),
        table(spark, d, "orders").select(*link("SHOP", F.col("o_orderkey").cast("string"), F.col("o_custkey"), F.col("o_orderstatus") == "F")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _masters(spark, d):
    return inputs.normalised(_frames(spark, d), SPECS, _xref(spark, d))


def _determined(spark, d):
    orders = table(spark, d, "orders")
    applied = orders.select(F.col("o_orderkey").alias("candidate"), F.col("o_custkey").alias("entity"), F.when(F.col("o_orderpriority") == "1-URGENT", dates.iso(F.col("o_orderdate"))).alias("hired"))
    found = inputs.evidence(applied, _xref(spark, d), "SHOP", "candidate", "entity", "hired")
    return inputs.determined(_masters(spark, d), found, {"ACQUIRED": "ACQUISITION"}, SERIES_START)


_MASTERS = """r AS (
  SELECT 'CORE' AS source_system, 'customer' AS source_dataset, 'CORE|customer|' || c_custkey AS source_row_id, 'C' || c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS own,
    c_name AS name, c_mktsegment AS unit, CAST(c_nationkey AS VARCHAR) AS country, CASE WHEN c_custkey % 11 <> 0 THEN strftime(DATE '1992-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') END AS start FROM customer
  UNION ALL SELECT 'ACQUIRED', 'customer', 'ACQUIRED|customer|' || c_custkey, 'A' || c_custkey, NULL, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT 'LEGACY', 'supplier', 'LEGACY|supplier|' || s_suppkey, CAST(s_suppkey AS VARCHAR), NULL, s_name, NULL, CAST(s_nationkey AS VARCHAR), NULL FROM supplier),
x AS (SELECT 'CORE' AS s, 'C' || c_custkey AS i, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS e, CASE WHEN c_custkey % 3 = 1 THEN 'RESOLVED' ELSE 'MANUAL_REVIEW' END AS status FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'ACQUIRED', 'A' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'MANUAL_REVIEW' END FROM customer
  UNION ALL SELECT 'LEGACY', CAST(s_suppkey AS VARCHAR), s_suppkey + 1000000, 'RESOLVED' FROM supplier WHERE s_suppkey % 4 = 1),
m AS (SELECT r.* EXCLUDE (own), CASE WHEN coalesce(own, CAST(e AS VARCHAR)) IS NULL THEN 'SRC:' || source_system || ':' || source_id ELSE 'ID:' || coalesce(own, CAST(e AS VARCHAR)) END AS person, coalesce(own, CAST(e AS VARCHAR)) AS entity_id,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN e IS NOT NULL THEN 'cross_reference' ELSE 'unresolved' END AS identity_basis, CASE WHEN own IS NOT NULL THEN 'RESOLVED' ELSE coalesce(status, 'UNRESOLVED') END AS identity_status, own IS NULL AND e IS NULL AS provisional
  FROM r LEFT JOIN x ON source_system = s AND source_id = i)"""
_ORIGINS = f"""{_MASTERS},
h AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS e FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
t AS (SELECT m.*, CASE WHEN source_system = 'ACQUIRED' THEN 'P1' WHEN start < '{SERIES_START}' THEN 'P2' WHEN h.e IS NOT NULL THEN 'P3' END AS rule FROM m LEFT JOIN h ON m.entity_id = h.e),
u AS (SELECT *, CASE rule WHEN 'P1' THEN 'ACQUISITION' WHEN 'P2' THEN 'INITIAL' WHEN 'P3' THEN 'HIRED' ELSE 'UNDETERMINED' END AS origin FROM t),
p AS (SELECT person, bool_and(provisional) AS provisional, count(*) AS records, count(DISTINCT source_system) AS systems, CASE min(coalesce(rule, '~')) WHEN 'P1' THEN 'ACQUISITION' WHEN 'P2' THEN 'INITIAL' WHEN 'P3' THEN 'HIRED' ELSE 'UNDETERMINED' END AS origin, min(rule) AS rule,
  min(source_system) FILTER (rule = best) AS evidence_system FROM (SELECT *, min(rule) OVER (PARTITION BY person) AS best FROM u) GROUP BY 1)"""


@query(f"WITH {_MASTERS} SELECT * FROM m")
def input_masters(spark, d):
    """Masters of three sources, a fourth being missing, under one set of names, each with its person."""
    return _masters(spark, d)


@query(f"""WITH {_MASTERS} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'C' || o_custkey AS source_id, CASE WHEN e IS NULL THEN 'SRC:CORE:C' || o_custkey ELSE 'ID:' || e END AS person, CAST(e AS VARCHAR) AS entity_id,
  CASE WHEN e IS NULL THEN 'unresolved' ELSE 'cross_reference' END AS identity_basis, coalesce(status, 'UNRESOLVED') AS identity_status, e IS NULL AS provisional FROM orders LEFT JOIN x ON s = 'CORE' AND i = 'C' || o_custkey
""")
def input_events(spark, d):
    """Orders as events of a source, each with its person; the events carry no id of their own."""
    events = table(spark, d, "orders").select("o_orderkey", dates.iso(F.col("o_orderdate")).alias("day"), F.lit("CORE").alias("source_system"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"))
    return inputs.with_person(events, _xref(spark, d), "source_system", "source_id").drop("source_system")


@query(f"WITH {_ORIGINS} SELECT * EXCLUDE (s) FROM (SELECT *, 1 AS s FROM u)")
def input_origins(spark, d):
    """Every master record with its origin and the rule that told it."""
    return _determined(spark, d)


@query(f"WITH {_ORIGINS} SELECT * FROM p")
def person_origins(spark, d):
    """Every person with the origin that the rule counting most gave them, over all their records."""
    return inputs.persons(_determined(spark, d))


@query(f"""WITH {_ORIGINS}, c AS (SELECT count(*) FILTER (origin = 'UNDETERMINED') AS und, count(*) FILTER (origin <> 'UNDETERMINED') AS det, count(*) FILTER (origin = 'ACQUISITION') AS acq FROM p)
SELECT 'persons' AS section, 'ALL' AS member, count(*) AS n FROM p UNION ALL SELECT 'persons', 'PROVISIONAL', count(*) FILTER (provisional) FROM p
UNION ALL SELECT 'contamination', 'UNDETERMINED', und FROM c UNION ALL SELECT 'contamination', 'AT_MOST', least(und, CAST(ceil(und * acq / det) AS BIGINT)) FROM c
UNION ALL SELECT 'origin', origin, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'rule', coalesce(rule, 'NONE'), count(*) FROM p GROUP BY 2
UNION ALL SELECT 'rows', 'masters', count(*) FROM m UNION ALL SELECT 'rows', 'events', count(*) FROM orders
""")
def build_summary(spark, d):
    """Rows, persons, provisional ones, origins, rules and the bound of what is undetermined."""
    return inputs.summary(inputs.persons(_determined(spark, d)), {"masters": _masters(spark, d), "events": table(spark, d, "orders")}, "ACQUISITION")


_FOUND = [("known", "CRITICAL", "INVALID", 0.3, "SELECT count(entity_id) FROM m", "SELECT count(*) FROM m WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT CAST(e AS VARCHAR) FROM y)"),
          ("linked", "WARNING", "IDENTITY_UNRESOLVED", 0.5, "SELECT count(*) FROM y", "SELECT count(*) FROM y WHERE status <> 'RESOLVED'"),
          ("reads", "CRITICAL", "INVALID", 0.1, "SELECT count(*) FROM z WHERE day IS NOT NULL AND day <> ''", "SELECT count(*) FROM z WHERE day = 'soon'"),
          ("one_reading", "WARNING", "INVALID", 0.5, "SELECT count(*) FROM z", "SELECT count(*) FROM z WHERE day LIKE '__/__/____' AND CAST(substr(day, 1, 2) AS INTEGER) <= 12 AND substr(day, 1, 2) <> substr(day, 4, 2) AND CAST(substr(day, 4, 2) AS INTEGER) <= 12")]


@query(f"""WITH {_MASTERS},
y AS (SELECT c_custkey AS e, CASE WHEN c_custkey % 3 = 1 THEN 'RESOLVED' ELSE 'MANUAL_REVIEW' END AS status FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 500000, 'MANUAL_REVIEW' FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'MANUAL_REVIEW' END FROM customer UNION ALL SELECT s_suppkey + 1000000, 'RESOLVED' FROM supplier WHERE s_suppkey % 4 = 1
  UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'MANUAL_REVIEW' END FROM orders),
z AS (SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'soon' WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
got AS ({" UNION ALL ".join(f"SELECT '{i}' AS check_id, '{s}' AS severity, '{f}' AS finding, {m} AS most, CAST(({e}) AS BIGINT) AS evaluated, CAST(({x}) AS BIGINT) AS failed" for i, s, f, m, e, x in _FOUND)})
SELECT check_id, severity, finding, evaluated, failed, CAST(round(failed / nullif(evaluated, 0), 6) AS DOUBLE) AS rate, CASE WHEN failed / evaluated <= most THEN 'PASS' ELSE 'FAIL' END AS status FROM got
""")
def dq_identity_layer(spark, d):
    """Masters against the identity layer, the layer's own coverage, and days that don't read or read in two ways."""
    k = F.col("o_orderkey")
    day = F.when(k % 29 == 0, "soon").when(k % 31 == 0, "").when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(dates.iso(F.col("o_orderdate")))
    read = dates.parsed_date(day, "dd/MM/yyyy", 2030)
    events = table(spark, d, "orders").select("o_orderkey", read["iso"].alias("day"), read["parse"].alias("day__parse"), read["ambiguous"].alias("day__ambiguous"))
    frames = quality.with_identity({"masters": _masters(spark, d), "events": events}, _xref(spark, d))
    return quality.run([
        Check("known", "masters", "in_reference", "entity_id", most=0.3, args={"reference": "identity", "column": "entity_id"}), Check("linked", "identity_xref", "in_set", "match_status", "WARNING", "IDENTITY_UNRESOLVED", 0.5, {"values": ["RESOLVED"]}),
        Check("reads", "events", "parse_ok", "day", most=0.1), Check("one_reading", "events", "not_ambiguous", "day", "WARNING", most=0.5),
    ], frames)


@query(f"""WITH {MAPPED_SQL}, f AS (SELECT priority AS source_value, count(*) AS occurrences, min(day) AS first_seen, max(day) AS last_seen FROM mapped WHERE std_priority = 'UNMAPPED' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY occurrences DESC, source_value) AS place FROM f
""")
def mapping_queue_order(spark, d):
    """Values without an entry in the order in which people decide on them: the most frequent first."""
    return mapping.in_order(mapping.exceptions(mapped_orders(spark, d), "priority", "priority", "day"), "occurrences", "source_value")


@query(r"""
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '  ' || user_id || chr(9) WHEN 1 THEN '+' || user_id WHEN 2 THEN '-' || user_id WHEN 3 THEN user_id || '.0' WHEN 4 THEN '' ELSE '9999999999999999999' || user_id END AS given, user_id, event_type, value FROM events)
SELECT event_id, CASE WHEN regexp_matches(given, '^\s*[+-]?[0-9]+\s*$') THEN CASE WHEN event_id % 6 = 2 THEN -user_id WHEN event_id % 6 < 2 THEN user_id END END AS number, event_type AS kind, CAST(user_id AS VARCHAR) AS person FROM t
""")
def lenient_maps(spark, d):
    """Whole numbers from text that may hold anything, and a row's map written as JSON and read back."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    given = F.when(k % 6 == 0, F.concat(F.lit("  "), user, F.lit("\t"))).when(k % 6 == 1, F.concat(F.lit("+"), user)).when(k % 6 == 2, F.concat(F.lit("-"), user)).when(k % 6 == 3, F.concat(user, F.lit(".0"))).when(k % 6 == 4, "").otherwise(F.concat(F.lit("9999999999999999999"), user))
    stored = F.to_json(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("person"), user))
    rows = table(spark, d, "events").select("event_id", text.lenient_int(given).alias("number"), stored.alias("stored"))
    read = F.from_json("stored", "map<string,string>")
    return rows.select("event_id", "number", read["kind"].alias("kind"), read["person"].alias("person"))
