"""New files as they land: staged, standardised and checked micro-batch by micro-batch, and counters by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.operators import quality
from lodestar.specs import Check


def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def checked(stream: DataFrame, dataset: str, checks: list[Check], out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch's approved rows and check results, in folders named by the batch, so a batch done again is written once."""

    def one(batch: DataFrame, epoch: int) -> None:
        rows = prepare(batch).persist()
        approved, excluded = quality.quarantined(rows, checks)
        approved.write.mode("overwrite").parquet(f"{out}/approved/batch={epoch}")
        excluded.write.mode("overwrite").parquet(f"{out}/excluded/batch={epoch}")
        quality.run(checks, {dataset: rows}).write.mode("overwrite").parquet(f"{out}/results/batch={epoch}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and nulls of ``keys`` by event-time window; rows later than ``late`` are left out of closed windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys]).select(F.col("w.start").alias("start"), "rows", *[f"null_{k}" for k in keys])
