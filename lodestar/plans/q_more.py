"""Queries: calibration, rates, bounds, sweeps and exact quantiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.operators import calibration, layers
from lodestar.plans.q_metrics import BASE, order_base
from lodestar.plans.q_rows import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""
WITH t AS (SELECT 'D' || (o_orderkey % 4) AS defect_id, o_orderstatus AS dataset, CASE o_orderkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.02 WHEN 2 THEN 0.5 ELSE 0.3 END AS p, o_orderkey FROM orders),
a AS (SELECT defect_id, dataset, count(*) AS eligible, CAST(avg(CAST(p AS DECIMAL(18,6))) AS DOUBLE) AS p, count(*) FILTER (WHERE defect_id <> 'D3' AND o_orderkey % 11 = 0) AS hits FROM t GROUP BY 1, 2)
SELECT defect_id, dataset, eligible, hits, CAST(round(p, 5) AS DOUBLE) AS expected_rate, CAST(round(hits / eligible, 5) AS DOUBLE) AS realized_rate,
  CASE WHEN hits = 0 THEN 'NOT_APPLIED' WHEN eligible < 200 THEN 'NO_SAMPLE' WHEN abs(hits / eligible - p) <= greatest(3 * sqrt(p * (1 - p) / eligible), 0.2 * p) THEN 'OK' ELSE 'OFF' END AS status FROM a
""")
def ledger_calibration(spark, d):
    k = F.col("o_orderkey")
    rate = F.when(k % 4 == 0, 0.1).when(k % 4 == 1, 0.02).when(k % 4 == 2, 0.5).otherwise(0.3)
    tried = table(spark, d, "orders").select(F.concat(F.lit("D"), (k % 4).cast("string")).alias("defect_id"), F.col("o_orderstatus").alias("dataset"), rate.alias("expected_rate"), "o_orderkey")
    hit = tried.where("defect_id <> 'D3' AND o_orderkey % 11 = 0")
    return calibration.calibrated(tried, hit, ["defect_id", "dataset"])


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS undetermined, CAST(round(count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') / count(*), 4) AS DOUBLE) AS undetermined_rate,
  count(*) FILTER (WHERE c_mktsegment = 'FURNITURE' AND c_acctbal < 0) AS at_most, CAST(round(count(*) FILTER (WHERE c_mktsegment = 'FURNITURE' AND c_acctbal < 0) / count(*), 4) AS DOUBLE) AS at_most_rate FROM customer
""")
def contamination_bounds(spark, d):
    return calibration.undetermined_bounds(table(spark, d, "customer"), "c_mktsegment", "FURNITURE", (F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") < 0))


@query(f"""{BASE}, s AS (SELECT "year", "month", count(DISTINCT entity) AS n FROM b GROUP BY 1, 2), m AS (SELECT "year", count(*) AS months, sum(n) / count(*) AS mean FROM s GROUP BY 1),
c AS (SELECT "year", count(*) FILTER (WHERE status = 'F') AS closed, count(*) FILTER (WHERE priority = '1-URGENT') AS urgent FROM b GROUP BY 1)
SELECT m."year" AS "year", months, CAST(round(mean, 4) AS DOUBLE) AS mean_stock, CAST(round(closed / mean * (12 / months), 4) AS DOUBLE) AS closed_rate, CAST(round(urgent / mean * (12 / months), 4) AS DOUBLE) AS urgent_rate FROM m JOIN c ON m."year" = c."year"
""")
def annualised_rates(spark, d):
    base = order_base(spark, d)
    return calibration.annualised(base, base, "year", "month", "entity", {"closed": F.col("status") == "F", "urgent": F.col("priority") == "1-URGENT"})


@query("SELECT o_custkey, arg_max(o_orderkey, k) AS o_orderkey, arg_max(o_totalprice, k) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) GROUP BY 1")
def last_observation(spark, d):
    return calibration.last_value(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("""
WITH v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 5 END AS z, CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) * CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS r FROM orders),
-- Days on which a version of each rank is open: what begins no later less what has ended, by rank and day.
p AS (SELECT r, t, sum(x) AS x FROM (SELECT r, a AS t, 1 AS x FROM v UNION ALL SELECT r, z + 1, -1 FROM v WHERE z IS NOT NULL) GROUP BY r, t),
n AS (SELECT r, t, sum(x) OVER (PARTITION BY r ORDER BY t) AS n FROM p),
s AS (SELECT DISTINCT a FROM v), q AS (SELECT DISTINCT r FROM v),
g AS (SELECT s.a, q.r FROM s CROSS JOIN q),
o AS (SELECT g.a, max(g.r) AS top FROM g ASOF JOIN n ON g.r = n.r AND g.a >= n.t WHERE n.n > 0 GROUP BY g.a)
SELECT o_orderkey, v.a AS start FROM v JOIN o ON v.a = o.a WHERE o.top > v.r
""")
def theta_outranked(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rank = (5 - F.substring("o_orderpriority", 1, 1).cast("int")) * F.when(k % 97 == 0, 2).otherwise(1)
    v = table(spark, d, "orders").select("o_orderkey", day.alias("start"), F.when(k % 50 != 0, F.date_add(day, 5)).alias("end"), rank.alias("rank"))
    return calibration.outranked(v, "o_orderkey", "rank", "start", "end")


@query("""
SELECT l_returnflag, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.9) AS p90, median(l_quantity) AS p50 FROM lineitem GROUP BY 1
""")
def agg_quantiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.percentile("l_quantity", 0.1).alias("p10"), F.percentile("l_quantity", 0.9).alias("p90"), F.median("l_quantity").alias("p50"))


@query("SELECT CASE WHEN o_orderkey % 37 = 0 THEN 'EXCLUDED' ELSE 'APPROVED' END AS status, count(*) AS \"rows\" FROM orders GROUP BY 1")
def status_split(spark, d):
    o = table(spark, d, "orders")
    return layers.split_by(o, o.where("o_orderkey % 37 = 0").select(F.col("o_orderkey").alias("row_id")), "o_orderkey")


@query("SELECT o_orderstatus, 'analytical' AS layer, count(*) AS n FROM orders GROUP BY 1")
def layer_stamp(spark, d):
    counted = layers.stamped(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "analytical")
    return layers.asserted(counted, "analytical").select("o_orderstatus", "layer", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'NUMERIC' ELSE 'TEXT' END AS scale_type, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, strftime(o_orderdate, '%Y-%m') AS \"month\" FROM orders")
def scale_and_flags(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "NUMERIC").otherwise("TEXT").alias("scale_type"), (F.col("o_orderstatus") == "F").cast("int").alias("closed"), dates.month_of(F.col("o_orderdate")).alias("month"))
