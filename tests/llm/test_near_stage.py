"""The near_duplicates stage and the operator at a similarity of 0.80, which its 25 bands of 0.85 don't reach."""

import random

import corpus_pipeline
from lodestar.llm import _store, minhash
from tests.llm.test_minhash import sets


def kept(rows, percent):
    s = sets(rows)
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


def pairs(seed, n):
    """Pairs of texts of 196 shingles, of which four changed words take 20: a similarity of 176 / 216."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        one = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
        two = list(one)
        for at in (20, 60, 100, 140):
            two[at] = f"x{rnd.randint(0, 10**6)}"
        out += [" ".join(one), " ".join(two)]
    return list(enumerate(out))


def test_stage_at_80(spark):
    rows = pairs(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == kept(rows, 80) == set(range(0, 80, 2))
    assert kept(rows, 85) == set(range(80))


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IN (582, 875, 1, 255, 709, 944) OR doc_id % 5 = 0")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == kept(rows, 80) < kept(rows, 85)


def test_bands():
    assert minhash.bands_for(85) == 25
    for percent in (50, 80, 85, 95):
        missed = (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent)
        assert missed <= minhash.MISSED
