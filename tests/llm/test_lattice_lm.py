import math
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestar.llm import _store
from lodestar.llm.lattice_lm import Lattice, discount, scored, trained, vocabulary, word_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, weights, longest):
    """The sum over all segmentations, without logarithms."""
    b, total = b" " + word, [1.0] + [0.0] * (len(word) + 1)
    for j in range(1, len(b) + 1):
        total[j] = sum(total[i] * weights.get(b[i:j], 0.0) for i in range(max(0, j - longest), j))
    return total[-1]


@pytest.fixture(scope="module")
def lattice():
    return Lattice(*vocabulary(PATH))


def test_forward_against_brute_force(lattice):
    rnd = random.Random(1)
    words = [b"a", "éç中".encode(), b"x" * 60] + [bytes(rnd.choice(b"thonerad,.") for _ in range(rnd.randint(1, 25))) for _ in range(200)]
    weights = dict(zip(lattice.names, np.exp(lattice.weights), strict=True))
    for w, got in zip(words, lattice.log_probabilities(words), strict=True):
        assert got == pytest.approx(math.log(brute(w, weights, lattice.longest)), rel=1e-9)


def test_expected_uses_cover_each_byte_once(lattice):
    words = [b"thonre", b"and", "été".encode()] * 3
    uses, likelihood = lattice.expected(words, np.arange(1.0, 10.0))
    assert likelihood == pytest.approx(sum(c * x for c, x in zip(range(1, 10), lattice.log_probabilities(words), strict=True)))
    assert sum(u * len(n) for u, n in zip(uses, lattice.names, strict=True)) == pytest.approx(sum((len(w) + 1) * c for w, c in zip(words, range(1, 10), strict=True)))


def test_base_against_brute_force(spark):
    _store.ship(spark)
    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["The", "the", "of", "a,", "é", "z" * 70, f"w{rnd.randint(0, 40)}"]) for _ in range(rnd.randint(0, 30))) or None) for k in range(120)]
    got = {r.doc_id: r for r in scored(spark.createDataFrame(docs, "doc_id long, text string"), PATH, head_words=3, rounds=1).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in docs}
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, t in docs}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0


def test_training_gains_until_the_tolerance(spark):
    words = [b"thonre", b"andere", b"thand", "\xe9t\xe9".encode(), b"onreth"] * 40
    counts = spark.createDataFrame([(bytearray(w + b"%d" % k), 1) for k, w in enumerate(words)], "word binary, c long")
    names, first = vocabulary(PATH)
    _store.ship(spark)
    one, few, many = (trained(counts, names, first, rounds=r, tolerance=t) for r, t in ((1, 0), (9, 0.02), (9, 0.0)))
    likely = [Lattice(names, w).expected([w + b"%d" % k for k, w in enumerate(words)], np.ones(len(words)))[1] for w in (first, one, few, many)]
    assert likely == sorted(likely) and likely[3] - likely[2] < 0.05 * abs(likely[3])


def likeliest(counts_of_counts):
    """The discount by plain sums over all counts; a half where no word is seen once or none more often."""
    if 1 not in counts_of_counts or max(counts_of_counts) == 1:
        return 0.5
    grid = [k / 100 for k in range(1, 100)]
    return max(grid, key=lambda d: sum(n * (math.log(d) if c == 1 else c * math.log(c - 1 - d)) for c, n in counts_of_counts.items()))


def test_discount(spark):
    def of(counts_of_counts):
        return discount(spark.createDataFrame([(c,) for c, n in counts_of_counts.items() for _ in range(n)], "c long"))

    assert of({}) == of({5: 3}) == of({1: 4}) == 0.5
    few, many = of({1: 10, 2: 1000}), of({1: 500, 2: 100, 3: 30})
    assert 0 < few < 0.1 < many < 1
    for given in ({1: 10, 2: 1000}, {1: 500, 2: 100, 3: 30}, {1: 60, 2: 9, 250: 3, 5000: 2}):
        assert of(given) == likeliest(given)


def test_long_words_in_spans(lattice):
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"thonerad,.\xc3\xa9") for _ in range(rnd.choice([1, 3, 30, 90, 200]))) for _ in range(40)] + [b"", b"x" * 300]
    whole, likelihood = lattice.expected(words, np.arange(1.0, 43.0), wide=1000)
    for wide, span in ((0, 7), (0, 25), (0, 64), (40, 33), (0, 1000)):
        assert np.allclose(lattice.log_probabilities(words, wide, span), lattice.log_probabilities(words, 1000), rtol=1e-10)
        uses, same = lattice.expected(words, np.arange(1.0, 43.0), wide, span)
        assert same == pytest.approx(likelihood, rel=1e-10) and np.allclose(uses, whole, rtol=1e-8, atol=1e-12)


def test_text_of_5_mb_without_white_space():
    code = """
import resource, random, numpy as np, public_tokenizers
from lodestar.llm.lattice_lm import Lattice, vocabulary
lattice = Lattice(*vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
word = bytes(random.Random(3).choices(b"thonerad,.", k=5_000_000))
got = lattice.log_probabilities([word])[0]
uses, same = lattice.expected([word[:500_000]], np.ones(1))
assert got < 0 and abs(sum(u * len(n) for u, n in zip(uses, lattice.names)) - 500_001) < 1
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_500_000
"""
    assert subprocess.run([sys.executable, "-c", code], timeout=300).returncode == 0


def test_counters_are_bounded_by_bytes(spark):
    _store.ship(spark)
    docs = [(k % 4 > 0, " ".join([f"W{k % 7}", "long" * (k % 5 * 200), "end"])) for k in range(60)] + [(True, None), (False, ""), (True, " ")]
    df = spark.createDataFrame(docs, "train boolean, text string")
    want = Counter(w for t, x in docs if t for w in [*(x or "").encode().lower().split(), b""]) + Counter()
    want |= {w: 0 for t, x in docs if not t for w in (x or "").encode().lower().split() if w not in want}
    for hold in (0, 2_000, 64 << 20):
        assert {bytes(r.word): r.c for r in word_counts(df, hold).collect()} == want


def test_a_long_frequent_word_does_not_empty_the_head(spark):
    rows = [(k, f"alpha {'q' * 500} beta w{k % 9}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in scored(df, PATH, head_bytes=h, rounds=1).collect()} for h in (0, 20_000))
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_scores_against_brute_force(spark):
    """The whole model again by plain loops: counts, discount, pieces trained, all segmentations, sums over tokens."""
    _store.ship(spark)
    rnd = random.Random(8)
    docs = [(k, " ".join(rnd.choice(["The", "the", "of", "on\xe9", f"w{rnd.randint(0, 60)}", f"th{rnd.randint(0, 9)}on"]) for _ in range(rnd.randint(0, 40))) or None) for k in range(150)]
    got = {r.doc_id: r.score for r in scored(spark.createDataFrame(docs, "doc_id long, text string"), PATH, head_words=4, rounds=2).collect()}
    tokens = {k: (t or "").encode().lower().split() for k, t in docs}
    train = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 10]
    c = Counter(w for k in train for w in tokens[k])
    n, v = sum(c.values()) + len(train), len(c)
    names, first = vocabulary(PATH)
    weights = dict(zip(names, np.exp(first), strict=True))
    longest = max(map(len, names))
    for _ in range(2):
        uses = dict.fromkeys(names, 0.01)
        for w in c:
            b = b" " + w
            whole = brute(w, weights, longest)

            def part(x):
                total = [1.0] + [0.0] * len(x)
                for j in range(1, len(x) + 1):
                    total[j] = sum(total[i] * weights.get(x[i:j], 0.0) for i in range(max(0, j - longest), j))
                return total[-1]

            for i in range(len(b)):
                for j in range(i + 1, min(len(b), i + longest) + 1):
                    if b[i:j] in weights:
                        uses[b[i:j]] += part(b[:i]) * weights[b[i:j]] * part(b[j:]) / whole
        whole = sum(uses.values())
        weights = {k: x / whole for k, x in uses.items()}
    d = likeliest(Counter(c.values()))
    share = (d * v + 1) / (n + 2)
    for k, ws in tokens.items():
        want = sum(math.log10(max(c[w] - d, 0) / (n + 2) + share * brute(w, weights, longest)) for w in ws) + math.log10((len(train) + 1) / (n + 2))
        assert got[k] == pytest.approx(want, rel=1e-6)


def test_head_size_does_not_matter(spark):
    rows = [(k, f"alpha beta w{k % 9} w{k % 5}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in scored(df, PATH, head_words=h, rounds=1).collect()} for h in (0, 1000))
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_words_are_a_distribution(spark):
    """Probabilities of all one-byte words and the words of the corpus stay below 1."""
    df = spark.createDataFrame([(k, "a b c d") for k in range(1, 40)], "doc_id long, text string")
    texts = [(1000 + k, chr(k)) for k in range(33, 127)]
    got = scored(df.union(spark.createDataFrame([t for t in texts if zlib.crc32(str(t[0]).encode()) % 10 == 0], "doc_id long, text string")), PATH, rounds=1).where("doc_id >= 1000").collect()
    assert 0 < sum(10**r.score for r in got) < 1
