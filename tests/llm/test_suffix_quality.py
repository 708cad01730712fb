import random
import re
import subprocess
import sys

import pyarrow as pa
import pytest

from lodestar.llm import _store, suffix_quality
from lodestar.llm._batches import bytes_of
from lodestar.llm._words import words_of
from lodestar.llm.suffix_quality import measures, quality_signals, repeats


def brute(text, least=8):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, longest, reach = len(w), 0, [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                reach[i], longest = max(reach[i], k), max(longest, k)
    covered = {p for i, r in enumerate(reach) for p in range(i, i + r)}
    windows = [tuple(w[i : i + 8]) for i in range(n - 7)]
    eight = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(eight), "covered_words": len(covered), "longest_repeat": longest}


def texts():
    rnd = random.Random(1)
    out = [None, "", " ", "\n\n", "a", "a " * 30, "é# x\n" * 9, "a b c " * 12 + "d"]
    for _ in range(150):
        v = [rnd.choice(["a", "b", "éç", "ab*", "x y", "<>"]) for _ in range(rnd.choice([1, 2, 6]))]
        t = "".join(rnd.choice(v) + rnd.choice([" ", " ", "\n", "\t\n"]) for _ in range(rnd.randint(0, 90)))
        out.append(t + t[: rnd.randint(0, len(t))] if rnd.random() < 0.4 else t)
    return out


@pytest.mark.parametrize("least", [1, 3, 5, 8, 11])
def test_against_brute_force(least):
    given = texts()
    got = measures(pa.array(given), least)
    for k, t in enumerate(given):
        assert {c: int(v[k]) for c, v in got.items()} == brute(t, least), t


def test_maximal_repeats_against_brute_force():
    """Of each text the number of maximal repeats: strings that stand twice and no neighbour of all places is the same."""
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places = {}
        for i in range(len(w)):
            for j in range(i + 3, len(w) + 1):
                places.setdefault(tuple(w[i:j]), []).append((i, j))
        maximal = 0
        for at in places.values():
            left, right = {w[i - 1] if i else None for i, _ in at}, {w[j] if j < len(w) else None for _, j in at}
            maximal += len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right)
        words = words_of(*bytes_of(pa.array([t or ""])))
        assert repeats(words, 3)[2].tolist() == [maximal], t


def test_few_levels(monkeypatch):
    monkeypatch.setattr(suffix_quality, "LEVEL_BYTES", 1)
    test_against_brute_force(3)


def test_long_text():
    """50 MB in less than 1.5 GB, also where it is one repeat after another."""
    code = (
        "import resource, numpy as np, pyarrow as pa\nfrom lodestar.llm.suffix_quality import measures\n"
        "rng = np.random.default_rng(1)\nwords = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)).decode() for _ in range(20000)]\n"
        "text = ' '.join(words[k] for k in rng.integers(0, 20000, 3_500_000))\nassert len(text) > 24_000_000\n"
        "print(measures(pa.array([text + ' ' + text]), 5)['longest_repeat'])\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    lines = subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True).stdout.split("\n")
    assert lines[0] == "[3500000]" and int(lines[1]) < 1_500_000


def test_verdict(spark):
    _store.ship(spark)
    clean = " ".join(f"w{k}" for k in range(400))
    run = " ".join(f"w{k}" for k in range(300)) + " be" * 100
    twice = clean + " " + clean
    phrases = " ".join(f"w{k} " * 7 for k in range(30))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_signals(spark.createDataFrame([(1, clean), (2, run), (3, twice), (4, "short one"), (5, phrases)], "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (False, False)}
