"""Line dedup against a plain count of lines by document."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import _store
from lodestar.llm.line_dedup import SPACE, deduped_lines, drop_bitmaps, line_digests

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(_UP)


def brute(rows, least, chars=1):
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add((doc, text or ""))
    gone = {k for k, v in docs.items() if len(v) >= least and len(k) >= chars}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, docs):
    rnd = random.Random(seed)
    lines = ["", " ", "\t", "Menu", "menu ", "MENU\r", "ÉTÉ", "été", "Été", "x\x0b", "　x", "own é", "a|b", "$1"] + [f"line {k}" for k in range(30)]
    return [(k, rnd.choice([None, "", "\n", "same\ntext\nMenu"]) if rnd.random() < 0.2 else "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 25)))) for k in range(docs)]


@pytest.mark.parametrize(("seed", "docs", "least", "chars"), [(1, 60, 10, 1), (2, 80, 5, 1), (3, 40, 2, 5), (4, 30, 1, 1), (5, 30, 31, 1)])
def test_brute_force(spark, seed, docs, least, chars):
    rows = made(seed, docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_digests(df, min_docs=least, min_chars=chars).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=repr) == brute(rows, least, chars)


def test_hot_line_and_long_text(spark):
    rows = [(k, f"Hot line\nown {k}\nhot LINE ") for k in range(3000)] + [(9999, "\n".join(f"row {k}" if k % 3 else "hot line" for k in range(200_000)))]
    got = line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=repr) == brute(rows, 10)


def test_shuffle_joins_say_the_same(spark, monkeypatch):
    rows = made(6, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(_store, "BROADCAST_BYTES", -1)
    got = line_digests(df, min_docs=4).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=repr) == brute(rows, 4)


def test_first_line_stays(spark):
    rows = [(1, "a\nb\na"), (2, "A \nc"), (3, None), (4, "a")]
    got = {r.doc_id: (r.kept_text, r.n_dropped) for r in deduped_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, keep_first=True).collect()}
    assert got == {1: ("a\nb", 1), 2: ("c", 1), 3: ("", 0), 4: ("", 1)}


def test_rows_of_one_id(spark):
    # Rows of the same id and text are one document; null ids are told apart by their texts. Extra columns stay.
    rows = [(1, "x\ny", 5, "k"), (1, "x\ny", 6, None), (1, "x\nz", 7, ""), (None, "x", 8, "k"), (None, "x", 9, "k"), (None, "q\nx", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, line__key string")
    got = sorted((r.kept_text, r.line__key or "") for r in deduped_lines(df, min_docs=4).collect())
    assert got == [("", "k"), ("", "k"), ("q", "k"), ("y", ""), ("y", "k"), ("z", "")]
    assert "n_lines" in deduped_lines(df).columns and deduped_lines(df).count() == 6
    assert deduped_lines(df, min_docs=5).agg(F.sum("n_dropped")).first()[0] == 0


def test_empty_table_and_runs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_digests(empty).collect() == [] and drop_bitmaps(empty).collect() == []
    df = spark.createDataFrame([(k, "m\nm\nown\nM\nlast") if k else (0, "m\nm\nown\nM\nlast\nmore") for k in range(2)], "doc_id long, text string")
    runs = {r.line__doc: [tuple(x) for x in r.line__runs] for r in drop_bitmaps(df, min_docs=2).collect()}
    assert runs == {0: [(0, 5)], 1: [(0, 5)]}
    runs = drop_bitmaps(spark.createDataFrame([(0, "m\nm\nown\nM\nb"), (1, "m\nc")], "doc_id long, text string"), min_docs=2).where("line__doc = 0").first().line__runs
    assert [tuple(x) for x in runs] == [(0, 2), (3, 1)]


def test_no_python_in_the_plan(spark):
    got = line_digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
