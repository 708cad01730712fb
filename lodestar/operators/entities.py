"""The entity dimension and what attaches to it: cross-references, origins, masters without a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import keys
from lodestar.operators.versions import OPEN_END, first_by

#: A cross-reference counts only if it is resolved; of several the surest, then the smallest entity.
RESOLVED = "RESOLVED"


def attach_identity(df: DataFrame, xref: DataFrame, system: str, source_id: str) -> DataFrame:
    """``df`` with cross_id and match_status of its (source_system, source_id), one cross-reference each; rows never multiply.

    An entity is attached only where it is resolved; candidates for review keep their status and no entity.
    """
    order = [(F.col("match_status") == RESOLVED).desc(), F.col("confidence").desc(), F.col("entity_id")]
    one = first_by(xref.where("source_id IS NOT NULL"), ["source_system", "source_id"], order)
    one = one.select(F.col("source_system").alias("__s"), F.col("source_id").alias("__i"), F.when(F.col("match_status") == RESOLVED, F.col("entity_id")).alias("cross_id"), "match_status")
    return df.join(one, (df[system] == F.col("__s")) & (df[source_id] == F.col("__i")), "left").drop("__s", "__i")


def origins(rows: DataFrame, person: str, rules: list[tuple[str, Column]], otherwise: str = "UNDETERMINED") -> DataFrame:
    """(person, origin): the first of the rules (origin, condition) that holds for any row of the person."""
    place = F.lit(len(rules))
    for k, (_, condition) in reversed(list(enumerate(rules))):
        place = F.when(condition, k).otherwise(place)
    best = rows.where(F.col(person).isNotNull()).groupBy(person).agg(F.min(place).alias("__p"))
    names = F.array(*[F.lit(name) for name, _ in rules], F.lit(otherwise))
    return best.select(person, F.get(names, F.col("__p")).alias("origin"))


def with_masters(history: DataFrame, masters: DataFrame, entity: str, start: str) -> DataFrame:
    """The history and, for each master record without one, a single open version from its start on."""
    alone = masters.join(history.select(F.col(entity).alias("__e")).distinct(), F.col(entity) == F.col("__e"), "left_anti")
    alone = alone.select(entity, F.lit(1).cast("bigint").alias("version"), F.col(start).alias("effective_from"), F.lit(OPEN_END).alias("effective_to"), F.lit(True).alias("is_current"), F.lit("MASTER_ONLY").alias("change_reason"))
    return history.unionByName(alone, allowMissingColumns=True)


def dimension(history: DataFrame, masters: DataFrame, entity: str, attributes: list[str], name: str = "entity_sk") -> DataFrame:
    """Versions with the master's attributes and a surrogate key from 1 by entity and version."""
    side = masters.select(F.col(entity).alias("__e"), *attributes)
    joined = history.join(side, history[entity] == F.col("__e"), "left").drop("__e")
    return keys.numbered(joined, entity, name, ("version",))


def queue(found: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """What waits for a person: identities for review or ambiguous, without a decision; stale ones are those whose candidate
    is no longer the one that was decided on. Columns of identity.resolved() and ``state`` (OPEN or STALE)."""
    waits = found.where(F.col("match_status").isin("MANUAL_REVIEW", "AMBIGUOUS"))
    if reviewed is None:
        return waits.withColumn("state", F.lit("OPEN"))
    seen = reviewed.select(F.col("source_system").alias("__s"), F.col("source_id").alias("__i"), F.col("entity_id").alias("__d"))
    joined = waits.join(seen, (F.col("source_system") == F.col("__s")) & (F.col("source_id") == F.col("__i")), "left")
    state = F.when(F.col("__i").isNull(), "OPEN").when(~F.col("__d").eqNullSafe(F.col("entity_id")), "STALE")
    return joined.withColumn("state", state).where("state IS NOT NULL").drop("__s", "__i", "__d")


def hire_evidence(applications: DataFrame, person: str, hired: str) -> DataFrame:
    """Persons with a resolved application that ended in a hire, once each, with the first day of it."""
    return applications.where(F.col(person).isNotNull() & F.col(hired).isNotNull()).groupBy(person).agg(F.min(hired).alias("first_hire"))
