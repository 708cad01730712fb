"""Hashes of words: equal spans alone share one, also where a polynomial modulo 2^64 would not tell them apart."""

import random

import numpy as np

from lodestar.llm import _store, minhash, suffix_quality
from lodestar.llm._words import span_hashes, words_of


def thue_morse(rounds):
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def hashes(*words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)])).hash.tolist()


def test_patterned_words_differ():
    for rounds in range(1, 14):
        a, b = thue_morse(rounds)
        got = hashes(a, b, a)
        assert got[0] == got[2] != got[1]


def test_equal_spans_share_a_hash_wherever_they_stand():
    rnd = random.Random(3)
    some = ["x" * n for n in (1, 47, 48, 49, 50, 4096, 300_000)] + ["".join(rnd.choice("ab") for _ in range(n)) for n in (30, 48, 49, 200)]
    got = hashes(*some, *reversed(some), *some)
    n = len(some)
    assert got[:n] == got[2 * n :] == got[n : 2 * n][::-1] and len(set(got)) == n


def test_no_spans():
    assert len(span_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_operators_tell_patterned_words_apart(spark):
    _store.ship(spark)
    a, b = thue_morse(10)
    rows = [(1, f"{a} p q r s t u v {b} p q r s t u v"), (2, f"{a} w1 w2 w3 w4 w5"), (3, f"{b} w1 w2 w3 w4 w5"), (4, f"{a} w1 w2 w3 w4 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_quality.quality_signals(docs.where("doc_id = 1")).first().n_repeat_words == 0
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}
