"""Inputs of a model: masters and events of several sources under one set of names, each row with its person and origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import keys
from lodestar.operators import entities
from lodestar.specs import InputSpec

#: Rules of origin in the order in which they count for a person with several records.
BY_SYSTEM, BEFORE_SERIES, BY_EVIDENCE = "P1", "P2", "P3"
UNDETERMINED = "UNDETERMINED"


def with_person(df: DataFrame, xref: DataFrame, system: str, source_id: str, own_id: str | None = None) -> DataFrame:
    """``df`` with person, entity_id, identity_basis (own, cross_reference, unresolved), identity_status and provisional.

    A source's own id needs no cross-reference; an empty one is none. Without either, a person of its own stands for the
    source's id, and no link is made up. A null source id has no cross-reference. Rows are neither lost nor repeated.
    """
    known = entities.attach_identity(df, xref, system, source_id)
    own = F.nullif(F.trim(F.col(own_id).cast("string")), F.lit("")) if own_id else F.lit(None).cast("string")
    made = keys.entity_key(own, F.col("cross_id").cast("string"), F.col(system), F.coalesce(F.col(source_id).cast("string"), F.lit("")))
    status = F.when(own.isNotNull(), entities.RESOLVED).otherwise(F.coalesce("match_status", F.lit("UNRESOLVED")))
    told = known.withColumns({"__made": made, "__entity": F.coalesce(own, F.col("cross_id").cast("string")), "__status": status})
    return told.select(*df.columns, F.col("__made.entity_key").alias("person"), F.col("__entity").alias("entity_id"), F.col("__made.basis").alias("identity_basis"), F.col("__status").alias("identity_status"), F.col("__made.provisional").alias("provisional"))


def _one(df: DataFrame, spec: InputSpec, names: list[str]) -> DataFrame:
    def text(source: str | None) -> Column:
        return F.col(source).cast("string") if source and source in df.columns else F.lit(None).cast("string")

    fixed = [F.lit(spec.system).alias("source_system"), F.lit(spec.dataset).alias("source_dataset"), text(spec.row_id).alias("source_row_id"), F.col(spec.id).cast("string").alias("source_id"), text(spec.own_id).alias("own_id")]
    return df.select(*fixed, *[text(dict(spec.columns).get(n)).alias(n) for n in names])


def normalised(frames: dict[tuple[str, str], DataFrame], specs: list[InputSpec], xref: DataFrame) -> DataFrame:
    """Rows of all datasets that are there, as text under the specs' names, each with its person.

    A name that a dataset has no column for is null there; a dataset that is missing adds no rows. All sources meet the
    cross-references in one join.
    """
    names = list(dict.fromkeys(n for s in specs for n, _ in s.columns))
    parts = [_one(frames[s.system, s.dataset], s, names) for s in specs if (s.system, s.dataset) in frames]
    if not parts:
        raise ValueError("none of the datasets is there")
    return with_person(reduce(lambda a, b: a.unionByName(b), parts), xref, "source_system", "source_id", "own_id").drop("own_id")


def evidence(applications: DataFrame, xref: DataFrame, system: str, candidate: str, entity: str, hired: str) -> DataFrame:
    """(entity_id, first_hire): entities with an application that ended in a hire and whose candidate is resolved in ``system``."""
    known = xref.where((F.col("source_system") == system) & (F.col("match_status") == entities.RESOLVED)).select(F.col("source_id").alias("__i")).distinct()
    seen = applications.where(F.nullif(F.col(hired).cast("string"), F.lit("")).isNotNull()).join(known, F.col(candidate).cast("string") == F.col("__i"), "left_semi")
    return entities.hire_evidence(seen, entity, hired).select(F.col(entity).cast("string").alias("entity_id"), F.col("first_hire"))


def determined(masters: DataFrame, found: DataFrame, decides: dict[str, str], series_start: str, start: str = "start", initial: str = "INITIAL", hired: str = "HIRED") -> DataFrame:
    """``masters`` with origin and rule of each record.

    P1: the source decides; P2: the record begins before the series; P3: evidence of a hire (``found`` of evidence());
    else UNDETERMINED without a rule. No attribute of the person is looked at.
    """
    side = found.select(F.col("entity_id").alias("__e"))
    joined = masters.join(side, F.col("entity_id") == F.col("__e"), "left")
    by_system = keys.member_of(F.col("source_system"), decides)
    early = F.coalesce(F.nullif(F.col(start), F.lit("")) < series_start, F.lit(False))
    rule = F.when(by_system.isNotNull(), BY_SYSTEM).when(early, BEFORE_SERIES).when(F.col("__e").isNotNull(), BY_EVIDENCE)
    origin = F.when(rule == BY_SYSTEM, by_system).when(rule == BEFORE_SERIES, initial).when(rule == BY_EVIDENCE, hired).otherwise(UNDETERMINED)
    return joined.withColumns({"origin": origin, "rule": rule}).drop("__e")


def persons(masters: DataFrame) -> DataFrame:
    """(person, provisional, records, systems, origin, rule, evidence_system): the record whose rule counts most tells the origin.

    Of records with one rule the first by source system, then by row id, counts. One aggregate, no window.
    """
    best = F.min(F.struct(F.coalesce("rule", F.lit("~")).alias("r"), "source_system", F.coalesce("source_row_id", F.lit("")).alias("i"), "origin", "rule")).alias("b")
    told = masters.groupBy("person").agg(F.bool_and("provisional").alias("provisional"), F.count(F.lit(1)).alias("records"), F.count_distinct("source_system").alias("systems"), best)
    return told.select("person", "provisional", "records", "systems", "b.origin", "b.rule", F.when(F.col("b.rule").isNotNull(), F.col("b.source_system")).alias("evidence_system"))


def summary(people: DataFrame, tables: dict[str, DataFrame], acquired: str) -> DataFrame:
    """(section, member, n) of a build: rows of each table, persons, provisional ones, by origin and rule, and how many of the
    undetermined could at most be ``acquired`` ones by the share among the determined (rounded up)."""
    cube = people.groupBy("origin", "rule", "provisional").agg(F.count(F.lit(1)).alias("n"))
    part = lambda section, member, rows: rows.groupBy(member.alias("member")).agg(F.sum("n").alias("n")).select(F.lit(section).alias("section"), "member", "n")
    total = cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("provisional"), F.col("n"))), F.lit(0)).alias("p"), *[
        F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("u", F.col("origin") == UNDETERMINED), ("d", F.col("origin") != UNDETERMINED), ("a", F.col("origin") == acquired))
    ])
    most = F.least(F.col("u"), F.coalesce(F.ceil(F.try_divide(F.col("u") * F.col("a"), F.col("d"))), F.lit(0)))
    entry = lambda section, member, n: F.struct(F.lit(section).alias("section"), F.lit(member).alias("member"), n.cast("bigint").alias("n"))
    totals = total.select(F.inline(F.array(entry("persons", "ALL", F.col("n")), entry("persons", "PROVISIONAL", F.col("p")), entry("contamination", "UNDETERMINED", F.col("u")), entry("contamination", "AT_MOST", most))))
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("section"), F.lit(name).alias("member"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), [totals, part("origin", F.col("origin"), cube), part("rule", F.coalesce("rule", F.lit("NONE")), cube), *rows])
