"""Trust of each metric in each cut, from the results of the checks that it depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lookups import small
from lodestar.specs import CERTIFIED, COMPONENTS, LEGITIMATE, LIMITED, PENDING_FLOOR, WEIGHING


def trust(results: DataFrame, depends: DataFrame) -> DataFrame:
    """(metric, cut, trust_score, loss_by_error, loss_by_pendency, a score for each component, status, reason, checks).

    One weighted mean: the loss is the failure rate of each check by the rows it evaluated. The losses of the classes add
    up to the whole loss. ``depends`` has metric and check_id; ``results`` is that of quality.run() with cuts.
    """
    used = F.col("severity").isin(*WEIGHING) & ~F.col("finding").isin(*LEGITIMATE) & (F.col("evaluated") > 0)
    lost = F.least(F.lit(1.0), F.col("failed") / F.col("evaluated")) * F.col("evaluated")
    rows = results.join(small(depends), "check_id").withColumn("weight", F.when(used, F.col("evaluated").cast("double"))).withColumn("lost", F.when(used, lost))
    weight = F.sum("weight")
    parts = {name: F.col("finding").isin(*classes) for name, classes in COMPONENTS.items()}
    sums = rows.groupBy("metric", "cut").agg(
        F.count("weight").alias("checks"), weight.alias("weight"), (F.sum("lost") / weight).alias("loss"), (F.sum(F.when(parts["validity"], F.col("lost"))) / weight).alias("error"),
        *[F.try_divide(F.sum(F.when(p, F.col("lost"))), F.sum(F.when(p, F.col("weight")))).alias(f"loss_{n}") for n, p in parts.items()],
    )
    error = F.coalesce("error", F.lit(0.0))
    pendency = F.coalesce("loss", F.lit(0.0)) - error
    score = F.when(F.col("loss").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("loss")))
    more = F.when(error > pendency, "ERROR").otherwise("PENDENCY")
    status = F.when(F.col("loss").isNull(), "UNDETERMINED").when(score >= CERTIFIED, "CERTIFIED").when((score >= LIMITED) | ((error < 1e-6) & (score >= PENDING_FLOOR)), "LIMITED").otherwise("BLOCKED")
    reason = (
        F.when(F.col("loss").isNull(), "NO_EVIDENCE").when((score >= CERTIFIED) & (error + pendency < 1e-9), "OK").when(score >= CERTIFIED, F.when(error >= pendency, "ERROR").otherwise("PENDENCY"))
        .when(score >= LIMITED, more).when((error < 1e-6) & (score >= PENDING_FLOOR), "PENDENCY").otherwise(more)
    )
    return sums.select(
        "metric", "cut", "checks", F.round(score, 6).alias("trust_score"), F.round(F.when(F.col("loss").isNotNull(), error), 6).alias("loss_by_error"), F.round(F.when(F.col("loss").isNotNull(), F.greatest(pendency, F.lit(0.0))), 6).alias("loss_by_pendency"),
        *[F.round(F.when(F.col(f"loss_{n}").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col(f"loss_{n}"))), 6).alias(n) for n in parts], status.alias("status"), reason.alias("reason"),
    )
