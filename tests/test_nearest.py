"""Nearest targets against every pair by plain loops: the whole rank lists, so recall is 1."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import similarity
from lodestar.operators import nearest
from lodestar.plans import q_rows
from lodestar.session import ship
from tests.test_functions import brute_scores


def best(values, texts, score, top, least=None):
    out = {}
    for v in {v for v in values if v is not None}:
        by = {}
        for standard, target in texts:
            if target is None:
                continue
            s = score(v, target)
            if (least is None or s > least) and (standard not in by or (-s, target) < (-by[standard][0], by[standard][1])):
                by[standard] = (s, target)
        out[v] = [(n, s, via) for n, (s, via) in sorted(by.items(), key=lambda kv: (-kv[1][0], kv[0]))][:top]
    return {v: r for v, r in out.items() if r}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ranked(df):
    out = {}
    for r in df.orderBy("value", "rank").collect():
        out.setdefault(r.value, []).append((r.target, round(r.score, 9), r.via))
        assert r.rank == len(out[r.value])
    return out


@pytest.mark.parametrize(("seed", "top"), [(2, 3), (3, 100)])
def test_by_distance(spark, seed, top):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aab cé") for _ in range(rnd.choice([0, 1, 2, 3, 6, 9, 14])))
    values, texts = [word() for _ in range(40)] + [None, "zzzzzzzz"], [(w, w) for w in (word() for _ in range(40))] + [(None, None)]
    asked, known = spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([t[1:] for t in texts], "target string")
    got = nearest.nearest(asked, known, "value", "target", top, -F.levenshtein("value", "target"), nearest.distance_rounds(asked, known, "value", "target"))
    assert ranked(got) == best(values, texts, lambda a, b: -levenshtein(a, b), top)


TEXTS = [("Customer Service", "Customer Service"), ("Customer Service", "Client Care"), ("Engineering", "Engineering"), ("Engineering", "Software Eng"), ("Research", "R and D"), ("Research", "Research Development"), ("People", "Human Resources"), ("People", "People"), ("Z", "Zürich"), ("N", None)]
VALUES = ["CS", "Eng", "Client Car", "Human Res.", "Develop Research", "people", None, "people", "", "qqq", "R. D.", "rd", "SE", "cust serv", "Ressources Humaines"]


@pytest.mark.parametrize("top", [2, 9])
def test_by_likeness_through_aliases(spark, top):
    known, asked = spark.createDataFrame(TEXTS, "standard string, target string"), spark.createDataFrame([(v,) for v in VALUES], "value string")
    score = similarity.similarity(F.col("value"), F.col("target"))["score"]
    got = ranked(nearest.nearest(asked, known, "value", "target", top, score, nearest.SHARE_ROUNDS, "standard").where("score > 0"))
    assert got == best(VALUES, TEXTS, lambda a, b: round(max(brute_scores(a, b).values()), 9), top, 0)


def test_the_whole_table(spark):
    """mapping_candidates over every product name of the small table."""
    ship(spark)
    names = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    texts = [(n, t) for n in names for t in {n, n.split(" ")[0]}]
    values = [n[:7].replace(" ", ". ") for n in names]
    want = best(values, texts, lambda a, b: round(max(brute_scores(a, b).values()), 9), 2, 0)
    got = q_rows.mapping_candidates(spark, "/root/testdata/sf0.001").where("score > 0")
    assert ranked(got) == want


def test_no_join_is_on_a_constant(spark):
    known, asked = spark.createDataFrame(TEXTS, "standard string, target string"), spark.createDataFrame([(v,) for v in VALUES], "value string")
    for r in (*nearest.SHARE_ROUNDS, *nearest.distance_rounds(asked, known, "value", "target")):
        plan = r.pairs(asked.select(F.col("value").alias("__v")), known.select(F.col("target").alias("__t")))._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty(spark):
    asked, known = spark.createDataFrame([], "value string"), spark.createDataFrame([("a",)], "target string")
    for a, b in ((asked, known), (known.withColumnRenamed("target", "value"), asked.withColumnRenamed("value", "target"))):
        got = nearest.nearest(a, b, "value", "target", 2, -F.levenshtein("value", "target"), nearest.distance_rounds(a, b, "value", "target"))
        assert got.collect() == []
