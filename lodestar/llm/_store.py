"""Shared storage for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import session

__all__ = ["BROADCAST_BYTES", "BROADCAST_KEYS", "FILE_ROWS", "bounded", "on_disk", "only", "shared_dir", "ship", "written"]

#: Distinct keys up to which a table is filtered by a broadcast of them; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000

#: Bytes up to which a table is broadcast to a join.
BROADCAST_BYTES = 16 << 20

#: Rows of narrow tables to a file.
FILE_ROWS = 50_000

#: Bytes of an Arrow batch between Spark and its Python workers, where the session has Spark's own default.
ARROW_BYTES, ARROW_SETTING, ARROW_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """The package on the workers, and batches that are small beside an executor's memory: texts are long."""
    session.ship(spark)
    if spark.conf.get(ARROW_SETTING, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one under /tmp/checkpoints where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the reading stage. The table goes when the driver ends.
    ``rows`` is how many rows it has at most, where that is known: it is then written by a task for each FILE_ROWS.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def on_disk(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for several uses; parts of a lost executor are computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def bounded(df: DataFrame, size: Column) -> DataFrame:
    """``df``, to be broadcast if its rows of ``size`` bytes each are summed and are at most BROADCAST_BYTES."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def only(df: DataFrame, on: str, keys: DataFrame, key: str, kind: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is among the keys (left_anti: is not). The keys are counted before they are broadcast."""
    keys = keys.select(F.col(key).alias("__only")).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, df[on] == keys["__only"], kind)
