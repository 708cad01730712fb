"""Expected against realised: ledgers of defects, rates by period, and bounds of what is undetermined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lookups import small


def calibrated(attempts: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, eligible, hits, expected_rate, realized_rate, status) of each kind of defect.

    ``attempts`` has a row and an expected_rate for each row that was eligible, ``ledger`` one for each that was hit. A
    rate is OK within three standard deviations or a fifth of what was expected, whichever is more.
    """
    tried = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible"), F.avg(F.col("expected_rate").cast("decimal(18,6)")).cast("double").alias("p"))
    hit = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    both = tried.join(hit, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    realized = F.col("hits") / F.col("eligible")
    tolerance = F.greatest(3 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("eligible")), 0.2 * F.col("p"))
    status = F.when(F.col("hits") == 0, "NOT_APPLIED").when(F.col("eligible") < 200, "NO_SAMPLE").when(F.abs(realized - F.col("p")) <= tolerance, "OK").otherwise("OFF")
    return both.select(*keys, "eligible", "hits", F.round("p", 5).alias("expected_rate"), F.round(realized, 5).alias("realized_rate"), status.alias("status"))


def undetermined_bounds(people: DataFrame, code: str, undetermined: str, at_most: Column) -> DataFrame:
    """(total, undetermined, undetermined_rate, at_most, at_most_rate): how many of the undetermined could be of one kind."""
    n, u, c = F.count(F.lit(1)), F.count_if(F.col(code) == undetermined), F.count_if(at_most)
    return people.agg(n.alias("total"), u.alias("undetermined"), F.round(F.try_divide(u, n), 4).alias("undetermined_rate"), c.alias("at_most"), F.round(F.try_divide(c, n), 4).alias("at_most_rate"))


def annualised(events: DataFrame, stock: DataFrame, year: str, month: str, entity: str, kinds: dict[str, Column]) -> DataFrame:
    """(year, months, mean_stock, a rate for each kind): events over the mean monthly stock, times 12 over the months seen."""
    monthly = stock.groupBy(F.col(year).alias("year"), F.col(month).alias("m")).agg(F.count_distinct(entity).alias("n"))
    mean = monthly.groupBy("year").agg(F.count(F.lit(1)).alias("months"), (F.sum("n") / F.count(F.lit(1))).alias("mean_stock"))
    counts = events.groupBy(F.col(year).alias("year")).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    rates = [F.round(F.coalesce(F.col(k), F.lit(0)) / F.col("mean_stock") * (12 / F.col("months")), 4).alias(f"{k}_rate") for k in kinds]
    return mean.join(counts, "year", "left").select("year", "months", F.round("mean_stock", 4).alias("mean_stock"), *rates)


def last_value(df: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """The last observation of each key: one aggregate, no sort."""
    return df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in take])


#: Days of the years 1 to 9999 are counted from 0 and are below 2^DAY_BITS.
FIRST_DAY, DAY_BITS = -719_162, 22


def outranked(df: DataFrame, ident: str, rank: str, start: str, end: str) -> DataFrame:
    """(ident, start) of each version at whose start some other version of higher rank is active; a null end is open.

    The theta join is one on equal keys: a span of days is the union of at most two blocks of 2^k days for each k, and a
    day lies in one block for each k. The highest rank of each block is kept, so what is joined is bounded by the days of
    the calendar, however many versions there are. Null ranks and starts neither outrank nor are outranked; a version that
    ends before it starts is never active.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date")) - FIRST_DAY
    after = F.when(F.col(end).isNull(), F.lit(1 << DAY_BITS)).otherwise(day(end) + 1)
    spans = df.where(F.col(start).isNotNull() & F.col(rank).isNotNull()).groupBy(day(start).alias("a"), after.alias("b")).agg(F.max(rank).alias("r"))
    blocks = []
    for k in range(DAY_BITS):
        lo, hi = F.shiftright(F.col("a") + ((1 << k) - 1), k), F.shiftright(F.col("b"), k)
        blocks += [F.when((lo < hi) & (lo % 2 == 1), F.struct(F.lit(k).alias("k"), lo.alias("block"))), F.when((lo < hi) & (hi % 2 == 1), F.struct(F.lit(k).alias("k"), (hi - 1).alias("block")))]
    blocks.append(F.when((F.col("a") == 0) & (F.col("b") == 1 << DAY_BITS), F.struct(F.lit(DAY_BITS).alias("k"), F.lit(0).alias("block"))))
    tops = spans.select("r", F.inline(F.array_compact(F.array(*blocks)))).groupBy("k", "block").agg(F.max("r").alias("r"))
    asked = df.where(F.col(start).isNotNull()).select(day(start).alias("__day")).distinct()
    within = asked.select("__day", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col("__day"), k).alias("block")) for k in range(DAY_BITS + 1)])))
    top = small(within.join(tops, ["k", "block"]).groupBy("__day").agg(F.max("r").alias("__top")))
    return df.join(top, day(start) == F.col("__day")).where(F.col("__top") > F.col(rank)).select(ident, start)


def discipline(ledger: DataFrame, catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    """(rule, defect_id, source_system) of each breach of a ledger of defects by its catalogue.

    UNDECLARED: a defect that the catalogue lacks. ELSEWHERE: in a system that does not declare it. ABSENT: declared and
    never seen. RATE: seen more than three standard deviations from its declared rate of the system's rows.
    ``catalogue`` has defect_id, source_system, rate; ``rows`` has source_system, n; the ledger is counted first.
    """
    seen = ledger.groupBy("defect_id", "source_system").agg(F.count(F.lit(1)).alias("seen"))
    known = catalogue.select(F.col("defect_id").alias("__d")).distinct()
    of = lambda rule, df: df.select(F.lit(rule).alias("rule"), "defect_id", "source_system")
    undeclared = seen.join(known, F.col("defect_id") == F.col("__d"), "left_anti")
    declared = seen.join(known, F.col("defect_id") == F.col("__d"), "left_semi")
    elsewhere = declared.join(catalogue, ["defect_id", "source_system"], "left_anti")
    absent = catalogue.join(seen, ["defect_id", "source_system"], "left_anti")
    both = catalogue.join(seen, ["defect_id", "source_system"]).join(rows, "source_system")
    off = both.where(F.abs(F.col("seen") - F.col("n") * F.col("rate")) > 3 * F.sqrt(F.col("n") * F.col("rate") * (1 - F.col("rate"))))
    return of("UNDECLARED", undeclared).unionByName(of("ELSEWHERE", elsewhere)).unionByName(of("ABSENT", absent)).unionByName(of("RATE", off))


def any_of(flags: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, flags), F.lit(False))
