"""Staging: every source becomes text columns and a row id; nothing is inferred."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.keys import numbered
from lodestar.sources.documents import read_records
from lodestar.sources.xlsx import read_xlsx
from lodestar.specs import SourceSpec


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def with_row_id(df: DataFrame, system: str, dataset: str, by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """_row_id = system|dataset|1..n in the order of the numeric (or numeric-text) landing column ``by``."""
    ordered = df.withColumn("__by", F.col(by).try_cast("double"))
    out = numbered(ordered, "__by", "__n", ties)
    return out.withColumn("_row_id", F.concat_ws("|", F.lit(system), F.lit(dataset), F.col("__n").cast("string"))).drop("__by", "__n")


def first_file(spark: SparkSession, spec: SourceSpec, path: str) -> str:
    """The first file of the source's format in all folders under ``path``, by the order of folder and file names."""
    glob = {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{spec.format}"}
    found = spark.read.format("binaryFile").options(**glob).load(path).inputFiles()
    if not found:
        raise FileNotFoundError(f"{spec.system}.{spec.dataset}: no .{spec.format} file under {path}")
    return min(map(unquote, found), key=lambda f: f.split("/"))


def broken_lines(spark: SparkSession, spec: SourceSpec, path: str) -> DataFrame:
    """(file, lines, broken, unkeyed) of a CSV source: lines of more or fewer fields than the header, lines without their first field.

    read() cuts what such a line has too many and fills what it lacks with nulls; this counts them, file by file.
    """
    reader = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__broken", **spec.options)
    names = spec.columns or spark.read.options(header=True, **spec.options).csv(path).columns
    whole = T.StructType([T.StructField(c, T.StringType()) for c in (*names, "__broken")])
    rows = reader.schema(whole).csv(path).select(F.col("_metadata.file_name").alias("file"), "__broken", F.col(f"`{names[0]}`").alias("__first"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("__broken").alias("broken"), F.count_if(F.col("__first").isNull() | (F.col("__first") == "")).alias("unkeyed"))


def read(spark: SparkSession, spec: SourceSpec, path: str, partition: str = "latest") -> DataFrame:
    """A source as text. ``path`` may hold ingestion_date=… folders; the latest, the first or all of them are read.

    ``partition`` first_file reads the first file alone. A JSON source whose options name its array of ``records`` is
    read in byte ranges, a row a record; without, a document is a row.
    """
    if partition == "first_file":
        path = first_file(spark, spec, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns]) if spec.columns else None
    if spec.format == "csv":
        reader = spark.read.options(header=True, mode="PERMISSIVE", **spec.options)
        df = (reader.schema(schema) if schema else reader).csv(path)
    elif spec.format == "parquet":
        df = spark.read.options(**spec.options).parquet(path)
    elif spec.format == "json" and "records" in spec.options:
        return read_records(spark, path, **{"field" if k == "records" else k: v for k, v in spec.options.items()})
    elif spec.format == "json":
        df = spark.read.options(multiLine=True, **spec.options).json(path)
        return df
    elif spec.format == "xlsx":
        df = read_xlsx(spark, path)
    else:
        raise ValueError(f"{spec.system}.{spec.dataset}: no format {spec.format}")
    if "ingestion_date" in df.columns and partition in ("latest", "first"):
        chosen = df.agg((F.max if partition == "latest" else F.min)("ingestion_date").alias("d")).first()["d"]
        df = df.where(F.col("ingestion_date") == F.lit(chosen)).drop("ingestion_date")
    return as_text(df).select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in df.columns])


def split_nested(df: DataFrame, records: str, structs: dict[str, str], children: str, key: str) -> tuple[DataFrame, DataFrame]:
    """One document of records in two grains: the parents with their structs flattened (prefix by struct), and the children.

    A parent without children has no child row. All columns are text; a child carries its parent's ``key``.
    """
    return grains(df.select(F.explode(records).alias("r")).select("r.*"), structs, children, key)


def grains(rows: DataFrame, structs: dict[str, str], children: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Records, a row each, in the two grains of split_nested()."""
    fields = {f.name: f.dataType for f in rows.schema}
    plain = [F.col(c).cast("string") for c, t in fields.items() if c != children and not isinstance(t, (T.StructType, T.ArrayType))]
    flat = [F.col(f"{s}.{f.name}").cast("string").alias(f"{prefix}{f.name}") for s, prefix in structs.items() for f in fields[s]]
    nested = rows.select(F.col(key).cast("string").alias(key), F.explode(children).alias("__c"))
    child = [F.col(f"__c.{f.name}").cast("string").alias(f.name) for f in fields[children].elementType if f.name != key]
    return rows.select(*plain, *flat), nested.select(key, *child)


def json_fields(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """``df`` with text columns of a JSON text's top-level fields."""
    parsed = F.from_json(column, T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return df.withColumn("__j", parsed).select(*df.columns, *[F.col(f"__j.{f}").alias(f) for f in fields])


def landing_columns(df: DataFrame, system: str) -> DataFrame:
    """A file source's rows with the file and time they came from."""
    return df.withColumns({"_source_file": F.col("_metadata.file_name"), "_ingested_at": F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd"), "_source_system": F.lit(system)})


def temp_views(frames: dict[str, DataFrame], layer: str, session: SparkSession | None = None) -> None:
    """Views layer__name; with ``session`` (newSession()), the only objects that it knows."""
    for name, df in frames.items():
        view = re.sub(r"\W+", "__", f"{layer}__{name}").lower()
        if session is None:
            df.createOrReplaceTempView(view)
        else:
            df.createOrReplaceGlobalTempView(view)
            session.table(f"global_temp.{view}").createOrReplaceTempView(view)
