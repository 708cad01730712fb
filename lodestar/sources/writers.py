"""Sinks: Parquet by layer and by year, CSV, nested JSON, appended histories, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.reconcile import content_hash


def write_layer(frames: dict[str, DataFrame], root: str, layer: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{layer}/{name.replace('.', '/')}")


def write_by_year(df: DataFrame, path: str, date: str) -> None:
    """One folder for each year of ``date``; the year is in the path alone."""
    df.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").options(header=True, sep=sep, encoding=encoding).csv(path)


def write_nested(parents: DataFrame, children: DataFrame, key: str, name: str, path: str) -> None:
    """Parents with their children as an array, a JSON line each."""
    nested = children.groupBy(key).agg(F.collect_list(F.struct(*[c for c in children.columns if c != key])).alias(name))
    parents.join(nested, key, "left").write.mode("overwrite").json(path)


def write_sample(df: DataFrame, path: str, order: list[str], n: int = 1000) -> None:
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def manifest(frames: dict[str, DataFrame], **about: object) -> dict:
    """Rows, columns and content hash of each table, with what else describes the run."""
    return about | {"tables": {name: content_hash(df).first().asDict() for name, df in frames.items()}}
