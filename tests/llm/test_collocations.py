"""Collocations against plain counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import _store
from lodestar.llm.collocations import Automaton, Runs, beyond, chunks, collocations, guarded, phrase_counts, shard_counts, shards, summed

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(rows):
    """Counts of runs of one to four words by language, and of all words."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(_UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, least, top):
    f, n = runs_of(rows)
    out = []
    for lang, counts in f.items():
        found = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        scored = []
        for w, a in found.items():
            if any(len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x))) and 100 * b >= 80 * a for x, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b", "A", "the", "The", "of", "É", "été", "x　y", "(", "long-" * 9, "中", "\x00"]
    gaps = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    rows = []
    for _ in range(n):
        some = [rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 30))]
        rows.append(("".join(w + rnd.choice(gaps) for w in some), rnd.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" .,\n\t", "de"), ("a " * 50, "en"), ("a " * 50, "en")]


@pytest.mark.parametrize(("seed", "least", "top", "most", "bits"), [(1, 5, 2000, 8 << 20, None), (2, 3, 7, 300, None), (3, 4, 2000, 60, 18), (4, 30, 2000, 1000, None), (5, 1, 50, 5000, None)])
def test_brute_force(spark, seed, least, top, most, bits):
    _store.ship(spark)
    rows = made(seed, 250)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, f int").repartition(3)
    got = collocations(df, min_count=least, top=top, most=most, bits=bits)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows, least, top)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    import lodestar.llm.collocations as own

    _store.ship(spark)
    monkeypatch.setattr(own, "LEAST_BITS", 16)
    rows = [(" ".join(f"w{(k * 7919) % 40_000} w{k % 97} w{(k * 31) % 977}" for k in range(j, j + 3000)), "en") for j in range(0, 60_000, 3000)]
    got = phrase_counts(spark.createDataFrame(rows, "text string, lang string"), min_count=20, bits=16).collect()
    f, n = runs_of(rows)
    assert {(r.lang, r.phrase): r.f for r in got} == {("en", " ".join(w)): c for w, c in f["en"].items() if c >= 20} | {("en", ""): n["en"]}


@pytest.mark.parametrize("most", [20, 37, 64, 200, 100_000])
def test_chunks_count_everything_once(most):
    rnd = random.Random(most)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "bb", "ccc", "d" * 50]) + rnd.choice([" ", " ", " ", " ", ", "]) for _ in range(rnd.randint(0, 200)))
        total, words = Counter(), 0
        for chunk, twice in chunks(guarded([text.encode()]), most):
            phrases, counts, n = shard_counts(chunk, twice, Runs(chunk, 1))
            total.update(dict(zip(phrases, counts, strict=True)))
            words += n
        f, n = runs_of([(text, "x")])
        assert {k: v for k, v in total.items() if v} == {" ".join(w): c for w, c in f["x"].items()} and words == n["x"]


def test_guards_and_overlaps():
    own = Automaton([" a a ", " a ", " b a "])
    counts = own.counts(guarded([b"a a a ba a", b"b\ta. a"]).decode())
    assert {own.phrases[k]: n for k, n in counts.items()} == {" a a ": 2, " a ": 6, " b a ": 1}
    assert not Automaton([]).counts("x") and not np.any(Runs(guarded([b""]), 0).ok[0])


def test_long_text(spark):
    _store.ship(spark)
    rows = [("go on and on " * 300_000 + "z" * 100_000, "en")]
    got = collocations(spark.createDataFrame(rows, "text string, lang string"), most=1 << 20).collect()
    f, n = runs_of(rows)
    assert got and all(r.a == f["en"][tuple(r.phrase.split(" "))] and r.n == n["en"] for r in got)


def test_empty_table(spark):
    _store.ship(spark)
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_a_shard_hands_on_a_row_a_word_at_most():
    """Every run of 500 different words may be frequent: 4 * 500 - 6 runs, of which each word begins one that no longer one has."""
    data = guarded([" ".join(f"w{k}" for k in range(500)).encode(), b"a b a b", b"a b"])
    phrases, counts, words = shard_counts(data, b"", Runs(data, 1))
    left = dict(zip(*beyond(phrases, counts), strict=True))
    assert len(phrases) > 3 * words and len(left) <= words and sum(left.values()) == words
    assert {p: n for p, n in left.items() if p[0] != "w"} == {"a b a b": 1, "b a b": 1, "a b": 2, "b": 2}
    sums = Counter()
    for phrase, n in left.items():
        w = phrase.split(" ")
        sums.update({" ".join(w[:k]): n for k in range(1, len(w) + 1)})
    assert sums == dict(zip(phrases, counts, strict=True))


def received(df):
    """Rows that Spark took from the Python nodes of a query that has run."""

    def under(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return under(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        below = node.children()
        own = node.metrics().apply("pythonNumRowsReceived").value() if name == "MapInArrowExec" else 0
        return own + sum(under(below.apply(k)) for k in range(below.size()))

    return under(df._jdf.queryExecution().executedPlan())


def test_rows_of_the_scan_are_no_more_than_words(spark):
    """Forty partitions of the same 300 different words, each run at 40: the scan told 1,195 rows of each, now 301."""
    _store.ship(spark)
    text = " ".join(f"w{k}" for k in range(300))
    df = phrase_counts(spark.createDataFrame([(text, "en")] * 40, "text string, lang string").repartition(40))
    rows = df.collect()
    assert len(rows) == 4 * 300 - 6 + 1 and {r.f for r in rows} == {40, 12_000}
    assert received(df) <= 40 * 301


def test_shards_are_filled():
    """What is over when a language is cut begins its next shard: all shards but a language's last are full, nothing is lost."""
    texts = [f"x{k} y, " * 7 for k in range(600)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", None] * 200, "text": texts})
    found = list(shards(iter([batch]), 1000))
    f, n = runs_of(zip(texts, ["en", "de", None] * 200, strict=True))
    for lang in ("en", "de", "und"):
        own = [(chunk, twice) for name, chunk, twice in found if name == lang]
        words = Counter()
        for chunk, twice in own:
            words.update(chunk.split(b" "))
            words.subtract(twice.split(b" "))
        assert {w: c for w, c in words.items() if c and w not in (b"", b"\n")} == {w[0].encode(): c for w, c in f[lang].items() if len(w) == 1}
        assert max(len(c) for c, _ in own) <= 1000 and sum(len(c) < 500 for c, _ in own) <= 1


def test_a_language_is_told_by_few_tasks(spark):
    """Four languages mixed in forty partitions: the scan told each language's 300 words in all forty, now in its range of tasks."""
    _store.ship(spark)
    texts = [(" ".join(f"{lang}{k}" for k in range(300)), lang) for lang in ("de", "en", "fr", None)]
    before = 0
    for times in (40, 200):
        df = phrase_counts(spark.createDataFrame(texts * times, "text string, lang string").repartition(times))
        rows = df.collect()
        assert len(rows) == 4 * (4 * 300 - 6 + 1) and {r.f for r in rows} == {times, 300 * times}
        told = received(df)
        assert told <= (2 * spark.sparkContext.defaultParallelism + 3) * 301 and told <= 5 * (before or told)
        before = told


@pytest.mark.parametrize("most", [1, 500, 3000, 1 << 20])
def test_rows_are_summed_in_bounded_bytes(most):
    """Sums over what is handed on are those of the rows, whatever the bound; with room for all, a phrase has one row."""
    rnd = random.Random(most)
    rows = [[(rnd.choice(["en", "", "de"]), f"w{rnd.randint(0, 60)}", rnd.randint(-2, 9)) for _ in range(rnd.randint(0, 40))] for _ in range(50)]
    names = ["lang", "phrase", "f"]
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in batch], kinds) for batch in rows]
    want, got, n = Counter(), Counter(), 0
    for lang, phrase, f in (r for batch in rows for r in batch):
        want[lang, phrase] += f
    for batch in summed(iter(batches), most):
        assert batch.schema == kinds
        n += batch.num_rows
        for r in batch.to_pylist():
            got[r["lang"], r["phrase"]] += r["f"]
    assert got == want and n <= sum(map(len, rows)) and (most < 1 << 20 or n == len(want))
    assert list(summed(iter([]), most)) == []
