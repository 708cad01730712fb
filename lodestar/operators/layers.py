"""Layers, lineage and timing of a run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LayerError(ValueError):
    pass


def stamped(df: DataFrame, layer: str) -> DataFrame:
    """``df`` with column layer; stamping again changes nothing but the name."""
    return df.withColumn("layer", F.lit(layer))


def asserted(df: DataFrame, layer: str) -> DataFrame:
    """``df`` if all its rows are of ``layer``; else an error that names what was found."""
    if "layer" not in df.columns:
        raise LayerError(f"no layer, {layer} expected")
    found = [r["layer"] for r in df.select("layer").distinct().limit(3).collect()]
    if any(f != layer for f in found):
        raise LayerError(f"layers {sorted(map(str, found))}, {layer} expected")
    return df


class Run:
    """What a run did: objects and their inputs, and seconds of stages that forced their work."""

    def __init__(self, run_id: str, at: str) -> None:
        self.run_id, self.at, self.objects, self.stages = run_id, at, [], []

    def made(self, name: str, inputs: list[str], rows: int | None = None, rule: str = "") -> None:
        self.objects.append((self.run_id, self.at, name, ",".join(inputs), rows, rule))

    @contextmanager
    def stage(self, name: str, rows: int = 0) -> Iterator[None]:
        """Times a block; the block runs its own action, as plans that are only built take no time."""
        began = time.perf_counter()
        yield
        self.stages.append((self.run_id, name, time.perf_counter() - began, rows))

    def lineage(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.objects, "run_id string, at string, object string, inputs string, rows long, rule string")

    def timing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, "run_id string, stage string, seconds double, rows long").withColumn("micros_per_row", F.col("seconds") * 1e6 / F.nullif(F.col("rows"), F.lit(0)))

    def projected_minutes(self, factor: float) -> float:
        """Linear, so it is too low where there are fixed costs."""
        return sum(s[2] for s in self.stages) * factor / 60


def split_by(df: DataFrame, bad: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """(status, rows): approved and excluded rows of a dataset."""
    marked = df.join(bad.select(F.col("row_id").alias(row_id)).distinct().withColumn("__bad", F.lit(True)), row_id, "left")
    return marked.groupBy(F.when(F.col("__bad"), "EXCLUDED").otherwise("APPROVED").alias("status")).agg(F.count(F.lit(1)).alias("rows"))
