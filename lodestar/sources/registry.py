"""All sources of a run by one registry, and the layers that earlier steps have written."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.readers import as_text, read
from lodestar.specs import SourceSpec


class StepMissing(LookupError):
    """A layer is read before the step that writes it has run."""


def ingested(spark: SparkSession, registry: list[tuple[SourceSpec, str]], partition: str = "latest", split: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] | None = None) -> dict[str, DataFrame]:
    """SYSTEM.dataset -> its rows as text, for every (source, path); all are plans, nothing is read yet but schemas.

    ``split`` names datasets that become several, such as nested records in two grains. A name may come only once.
    """
    out: dict[str, DataFrame] = {}
    for spec, path in registry:
        name = f"{spec.system}.{spec.dataset}"
        df = read(spark, spec, path, partition)
        made = split[name](df) if split and name in split else {name: df}
        if again := out.keys() & made.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(again))}")
        out |= made
    return out


def layer(spark: SparkSession, folder: str, names: list[str], step: str, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of a layer; one that is not there is an error that names the step to run."""
    out = {}
    for name in names:
        if name.startswith(skip) if skip else False:
            continue
        try:
            out[name] = spark.read.parquet(os.path.join(folder, name))
        except AnalysisException as e:
            raise StepMissing(f"{folder} has no {name}: run {step} first") from e
    return out


def truth(spark: SparkSession, *parts: str) -> DataFrame:
    """A table of several parts as text, whose columns may differ: a column that a part lacks is null there."""
    frames = [as_text(spark.read.option("mergeSchema", "true").parquet(p)) for p in parts]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
