"""Queries: measures, roll-ups, comparisons, rankings and suppression, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import dates
from lodestar.plans import metrics
from lodestar.plans.q_rows import table
from lodestar.specs import Metric

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def order_base(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's dimensions and all periods."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(places, c["c_nationkey"] == places["n_nationkey"])
    return rows.select(
        "o_orderkey", F.col("c_custkey").alias("entity"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), *[p(F.col("o_orderdate")).alias(name) for name, p in dates.PERIODS.items()],
    )


BASE = """
WITH b AS (SELECT o_orderkey, c_custkey AS entity, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, c_mktsegment AS segment, n_name AS nation, r_name AS region,
  strftime(o_orderdate, '%Y-%m') AS "month", year(o_orderdate) || '-Q' || quarter(o_orderdate) AS "quarter", strftime(o_orderdate, '%Y') AS "year"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
DIMENSIONS = ("region", "nation", "segment", "priority", "status")
CATALOG = {
    m.id: m
    for m in (
        Metric("customers", "distinct", "entity", dimensions=DIMENSIONS, rollup="last_period", coverage=("1995-01", "2001-08"), minimum_n=5),
        Metric("order_value", "sum", "price", dimensions=DIMENSIONS, coverage=("1995-01", "2001-08")),
        Metric("median_price", "median", "price", population="o_orderkey", dimensions=DIMENSIONS, grain="quarter", coverage=("1995-Q1", "2001-Q2")),
        Metric("orders_per_customer", "distinct_ratio", "o_orderkey", "entity", dimensions=DIMENSIONS, coverage=("1995-01", "2001-08"), status="DECLARED"),
        Metric("urgent_share", "ratio", "urgent", "one", dimensions=DIMENSIONS, coverage=("1995-01", "2001-08"), minimum_n=20),
        Metric("margin", "ratio", "price", "price", status="BLOCKED", blockers=("no cost is recorded",)),
    )
}


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_sum_dec(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.sum("l_linenumber").alias("numbers"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS quantity, median(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def agg_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("quantity"), F.median("l_extendedprice").alias("price"))


@query("""
SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS numerator, CAST(sum(CASE WHEN l_linestatus = 'F' AND l_linenumber <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS denominator,
       CASE WHEN sum(CASE WHEN l_linestatus = 'F' AND l_linenumber <> 3 THEN 1 ELSE 0 END) = 0 THEN NULL ELSE CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN l_linestatus = 'F' AND l_linenumber <> 3 THEN 1 ELSE 0 END) END AS value
FROM lineitem GROUP BY 1
""")
def agg_ratio(spark, d):
    over, under = F.count_if(F.col("l_returnflag") == "R"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_linenumber") != 3))
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(over.alias("numerator"), under.alias("denominator"), F.try_divide(over.cast("double"), under).alias("value"))


@query("SELECT l_linestatus, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def agg_cond_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"), F.count_distinct("l_orderkey").alias("orders"))


@query(f"""{BASE}, x AS (SELECT "year" AS period, region, count(DISTINCT o_orderkey) AS numerator, count(DISTINCT entity) AS population FROM b WHERE status = 'F' GROUP BY 1, 2),
m AS (SELECT "year" AS period, region, "month", count(DISTINCT entity) AS n FROM b GROUP BY 1, 2, 3), e AS (SELECT period, region, (arg_min(n, "month") + arg_max(n, "month")) / 2.0 AS denominator FROM m GROUP BY 1, 2)
SELECT x.period, x.region, CAST(numerator AS DOUBLE) / CAST(denominator AS DOUBLE) AS value, CAST(numerator AS DOUBLE) AS numerator, CAST(denominator AS DOUBLE) AS denominator, population FROM x LEFT JOIN e ON x.period = e.period AND x.region IS NOT DISTINCT FROM e.region
""")
def agg_turnover_ends(spark, d):
    base = order_base(spark, d)
    return metrics.turnover(base.where("status = 'F'"), base, "year", "month", "o_orderkey", "entity", ("region",))


@query(f"""{BASE} SELECT "year" AS period, region, CAST(count(DISTINCT o_orderkey) AS DOUBLE) / count(DISTINCT entity) AS value, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS numerator, CAST(count(DISTINCT entity) AS DOUBLE) AS denominator, count(DISTINCT entity) AS population FROM b GROUP BY 1, 2""")
def agg_span_ratio(spark, d):
    return metrics.evaluated(CATALOG["orders_per_customer"], order_base(spark, d), "year", dimensions=("region",))


@query(f"""{BASE} SELECT "year" AS period, CAST(round(CAST(count(DISTINCT CASE WHEN segment = 'FURNITURE' THEN entity END) AS DOUBLE) / count(DISTINCT entity), 6) AS DOUBLE) AS rate FROM b GROUP BY 1""")
def agg_nondecl_rate(spark, d):
    """Share of entities whose segment counts as undeclared."""
    undeclared = F.count_distinct(F.when(F.col("segment") == "FURNITURE", F.col("entity")))
    return order_base(spark, d).groupBy(F.col("year").alias("period")).agg(F.round(undeclared / F.count_distinct("entity"), 6).alias("rate"))


@query(f"""{BASE}, l AS (SELECT * FROM b QUALIFY "month" = max("month") OVER (PARTITION BY "year")),
e AS (SELECT "year" AS period, region, count(DISTINCT entity) AS n FROM l GROUP BY 1, 2),
w AS (SELECT *, n < 30 AS below, count(*) FILTER (WHERE n < 30) OVER (PARTITION BY period) AS hidden, count(*) OVER (PARTITION BY period) AS many, row_number() OVER (PARTITION BY period ORDER BY n < 30, n, region) AS k FROM e),
s AS (SELECT *, CASE WHEN below THEN 'primary' WHEN hidden = 1 AND many >= 2 AND k = 1 THEN 'complementary' ELSE 'no' END AS suppression FROM w)
SELECT period, region, CASE WHEN suppression = 'no' THEN CAST(n AS DOUBLE) END AS value, CASE WHEN suppression = 'no' THEN n END AS population, suppression FROM s
""")
def kpi_stock_year(spark, d):
    """Customers with orders in the last month of each year by region; groups under 30 withheld."""
    result = metrics.evaluated(CATALOG["customers"], order_base(spark, d), "year", dimensions=("region",))
    return metrics.protected(result, 30, ["period"], ["region"])


@query(f"""{BASE} SELECT "month" AS period, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS value, count(DISTINCT entity) AS population FROM b GROUP BY 1""")
def kpi_flow_month(spark, d):
    return metrics.evaluated(CATALOG["order_value"], order_base(spark, d), "month")


@query(f"""{BASE} SELECT "year" AS period, segment, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS value, count(DISTINCT entity) AS population FROM b WHERE "year" BETWEEN '1996' AND '1999' AND region IN ('ASIA', 'EUROPE') GROUP BY 1, 2""")
def kpi_flow_year(spark, d):
    return metrics.evaluated(CATALOG["order_value"], order_base(spark, d), "year", ("1996", "1999"), ("segment",), {"region": ["ASIA", "EUROPE"]})


@query(f"""{BASE} SELECT "year" AS period, region, median(price) AS value, count(DISTINCT o_orderkey) AS population FROM b GROUP BY 1, 2""")
def kpi_median_year(spark, d):
    """A quarterly median told by year is computed anew, not averaged."""
    return metrics.evaluated(CATALOG["median_price"], order_base(spark, d), "year", dimensions=("region",))


@query(f"""{BASE} SELECT "quarter" AS period, CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value, CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS numerator, CAST(count(*) AS DOUBLE) AS denominator, count(DISTINCT entity) AS population FROM b GROUP BY 1""")
def kpi_ratio_quarter(spark, d):
    base = order_base(spark, d).withColumns({"urgent": (F.col("priority") == "1-URGENT").cast("int"), "one": F.lit(1)})
    return metrics.evaluated(CATALOG["urgent_share"], base, "quarter")


@query(f"""{BASE}, n AS (SELECT region, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS value FROM b WHERE "year" = '1998' GROUP BY 1), p AS (SELECT region, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS base FROM b WHERE "year" = '1997' GROUP BY 1)
SELECT n.region, value, base, value - base AS delta, CAST(round((value - base) / base, 6) AS DOUBLE) AS relative_delta, CASE WHEN value > base THEN 'UP' WHEN value < base THEN 'DOWN' ELSE 'STABLE' END AS direction FROM n JOIN p ON n.region = p.region
""")
def kpi_compare_prev(spark, d):
    base, m, year = order_base(spark, d), CATALOG["order_value"], "1998"
    before = dates.previous_period(year)
    now, then = (metrics.evaluated(m, base, "year", (y, y), ("region",)) for y in (year, before))
    return metrics.compared(now, then, ["region"])


@query(f"""{BASE}, v AS (SELECT nation, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS value FROM b WHERE "year" = '1999' GROUP BY 1)
SELECT nation, value, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, nation) AS INTEGER) AS rank FROM v QUALIFY row_number() OVER (ORDER BY value DESC NULLS LAST, nation) <= 10
""")
def topk_breakdown(spark, d):
    """The ten nations of the most order value; the report is the feature, so the limit is part of it."""
    rows = metrics.evaluated(CATALOG["order_value"], order_base(spark, d), "year", ("1999", "1999"), ("nation",))
    order = W.partitionBy("period").orderBy(F.desc_nulls_last("value"), "nation")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("nation", "value", "rank")


@query(f"""{BASE}, e AS (SELECT "quarter" AS period, nation, count(DISTINCT entity) AS population, CAST(count(DISTINCT entity) AS DOUBLE) AS value FROM b WHERE segment = 'BUILDING' GROUP BY 1, 2),
w AS (SELECT *, population < 3 AS below, count(*) FILTER (WHERE population < 3) OVER (PARTITION BY period) AS hidden, count(*) OVER (PARTITION BY period) AS many, row_number() OVER (PARTITION BY period ORDER BY population < 3, population, nation) AS k FROM e),
s AS (SELECT *, CASE WHEN below THEN 'primary' WHEN hidden = 1 AND many >= 2 AND k = 1 THEN 'complementary' ELSE 'no' END AS suppression FROM w)
SELECT period, nation, CASE WHEN suppression = 'no' THEN value END AS value, CASE WHEN suppression = 'no' THEN population END AS population, suppression FROM s
""")
def privacy_suppress(spark, d):
    rows = metrics.evaluated(Metric("c", "distinct", "entity", rollup="sum"), order_base(spark, d), "quarter", dimensions=("nation",), filters={"segment": ["BUILDING"]})
    return metrics.protected(rows, 3, ["period"], ["nation"])
