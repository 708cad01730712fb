"""A session set up as the engine expects it, and the package on its workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; sizes of partitions are left to adaptive execution and the cluster's own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs on one machine, as in tests, one under /tmp/checkpoints."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file:///tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage: a checkpoint in the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder, in a folder for each value of ``by``, until the driver ends.

    Unlike what cut() gives, a reader takes only the columns and folders it asks for.
    """
    spark = df.sparkSession
    path = f"{_shared(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.basename(root)
    out = os.path.join(tempfile.mkdtemp(), f"{top}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(top, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
