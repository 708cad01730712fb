"""One large JSON document {.., "records": [{..}, ..]} read in byte ranges, so that no task holds the whole file.

Spark's text source cuts the file at closing braces and splits it into ranges as it does with lines. What a range begins
with (inside a string or not, how deep, in the records or not) follows from the ranges before it. A first scan tells for
each range what it does to either beginning, two rows a range; a second one, which knows where it begins, cuts out the
records. A record that runs over the end of a range is put together from its parts afterwards, at most two a range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.session import ship

#: A whole string, with its colon if it is a key; a brace or bracket; a string that runs on.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(\s*:)?|[{}\[\]]|"', re.S)
_CLOSE = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"(\s*:)?', re.S)


class Reading:
    """Where a scan of a document stands: inside a string, how deep, whether the container at depth 2 holds the records."""

    def __init__(self, field: str, inside: bool = False, depth: int = 0, among: bool = False) -> None:
        self.key, self.inside, self.depth, self.among = json.dumps(field, ensure_ascii=False), inside, depth, among

    def steps(self, chunk: str) -> Iterator[tuple[int, str, bool]]:
        """(place after it, brace or bracket, whether it opens the array of the field) of each one outside strings; ``depth`` is then the one after it."""
        at, key = 0, ""
        if self.inside:
            if (m := _CLOSE.match(chunk)) is None:
                return
            self.inside, at = False, m.end()
        for m in _TOKEN.finditer(chunk, at):
            token = m[0]
            if token[0] == '"':
                if len(token) == 1:
                    self.inside = True
                    return
                key = token[:-1].rstrip() if m[1] else ""
                continue
            self.depth += 1 if token in "{[" else -1
            yield m.end(), token, token == "[" and key == self.key
            key = ""


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Each range's text, chunk by chunk; a chunk ends with a closing brace, so no escape runs over its end."""

    def runs() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            rows = zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True)
            for place, some in groupby(rows, key=lambda r: r[:2]):
                yield place, "".join(f"{r[2]}}}" for r in some)

    for place, some in groupby(runs(), key=lambda r: r[0]):
        yield place, (chunk for _, chunk in some)


def _effects(field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), chunks in _chunks(batches):
            both = [Reading(field, inside) for inside in (False, True)]
            opened: list[dict[int, bool]] = [{}, {}]
            for chunk in chunks:
                for reading, last in zip(both, opened, strict=True):
                    for _, token, wanted in reading.steps(chunk):
                        if token in "{[":
                            last[reading.depth] = wanted
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * 2), pa.array([start] * 2, pa.int64()), pa.array([False, True]), pa.array([r.inside for r in both]), pa.array([r.depth for r in both], pa.int32()), pa.array([list(o.items()) for o in opened], pa.map_(pa.int32(), pa.bool_()))],
                names=["file", "start", "given", "inside", "deeper", "opened"],
            )

    return run


def _beginnings(effects: list) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """What each range begins with, from the effects of all ranges before it in its file."""
    out = {}
    ordered = sorted(effects, key=lambda r: (r["file"], r["start"], r["given"]))
    for file, rows in groupby(ordered, key=lambda r: r["file"]):
        inside, depth, among = False, 0, False
        for start, pair in groupby(rows, key=lambda r: r["start"]):
            out[file, start] = (inside, depth, among)
            effect = list(pair)[inside]
            among = effect["opened"].get(2 - depth, among)
            inside, depth = effect["inside"], depth + effect["deeper"]
    return out


def _cutter(field: str, given: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), chunks in _chunks(batches):
            if (file, start) not in given:
                raise ValueError(f"{file}: ranges changed between two scans; read the document again")
            now, k = Reading(field, *given[file, start]), 0
            open_, first, parts = now.among and now.depth >= 3, False, []
            for chunk in chunks:
                since, found = 0, []
                for at, token, wanted in now.steps(chunk):
                    if now.depth == 2 and token in "{[":
                        now.among = wanted
                    elif now.depth == 3 and token == "{" and now.among and not open_:
                        open_, first, since = True, True, at - 1
                    elif now.depth == 2 and token == "}" and open_:
                        found.append((k, first, True, "".join([*parts, chunk[since:at]])))
                        k, open_, first, parts = k + 1, False, False, []
                if open_:
                    parts.append(chunk[since:])
                yield _rows(file, start, found)
            if open_:
                yield _rows(file, start, [(k, first, False, "".join(parts))])

    return run


def _rows(file: str, start: int, found: list[tuple[int, bool, bool, str]]) -> pa.RecordBatch:
    k, first, last, text = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()), pa.array(k, pa.int64()), pa.array(first, pa.bool_()), pa.array(last, pa.bool_()), pa.array(text, pa.string())], names=["file", "start", "k", "first", "last", "json"])


def record_texts(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """(file, start, k, json): each object of the array ``field`` of the documents at ``path`` as JSON text.

    file, start and k order the records as in the file. Ranges are as large as spark.sql.files.maxPartitionBytes. An empty
    file, a document without the field and an empty array have no rows; what else the document holds is passed over.
    """
    ship(spark)
    lines = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    effects = lines.mapInArrow(_effects(field), "file string, start bigint, given boolean, inside boolean, deeper int, opened map<int,boolean>").collect()
    cut = lines.mapInArrow(_cutter(field, _beginnings(effects)), "file string, start bigint, k bigint, first boolean, last boolean, json string")
    # A record that ends where it began is whole; the others' parts are few, and each record takes those up to the next first part.
    parts = cut.where("NOT (first AND last)").withColumn("n", F.sum(F.col("first").cast("int")).over(W.partitionBy("file").orderBy("start", "k")))
    joined = parts.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "k", "json"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["k"].alias("k"), F.array_join("p.json", "").alias("json"))
    return cut.where("first AND last").select("file", "start", "k", "json").unionByName(joined)


def read_records(spark: SparkSession, path: str, field: str = "records", schema: str | None = None) -> DataFrame:
    """The records as columns. Without a ``schema`` (DDL) their types are found by one aggregate over all records."""
    texts = record_texts(spark, path, field)
    if schema is None:
        found = texts.agg(F.schema_of_variant_agg(F.parse_json("json"))).first()[0]
        found = re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", re.sub(r"\b(VOID|VARIANT)\b", "STRING", found)))
        if not found.startswith("STRUCT<"):
            return spark.createDataFrame([], "struct<>")
        schema = found
    return texts.select(F.from_json("json", schema).alias("r")).select("r.*")
