"""Alignment against two pointers over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestar.llm import _store, token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LEFT = Tokenizer.from_file(A)
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=B)


def brute(text):
    """(A's tokens, B's, groups) by two pointers; nothing where a side changes the text."""
    if not text:
        return [], [], []
    side = token_align._sides(A, B)[0]
    a, b = LEFT.encode(" " + text, add_special_tokens=False).ids, RIGHT.encode(text)
    bytes_a = [side.bytes[i] for i in a]
    bytes_b = [bytes([int(RIGHT.id_to_piece(i)[3:5], 16)]) if RIGHT.is_byte(i) else RIGHT.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], []
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(bytes_a[i])
            left.append(a[i])
            i += 1
        else:
            at_b += len(bytes_b[j])
            right.append(b[j])
            j += 1
        if at_a == at_b and left and right:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


def texts(seed, n):
    rnd = random.Random(seed)
    plain = [*"abcdeé  \n\t.,'0123ÀßΩ中\U0001f600", "the", " of", "ing", "   ", "\n\n"]
    odd = ["▁", "\x00", "\xa0", "\r", "\r\n", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>"]
    return [None, "", " ", "  ", "\n", "▁", "x" * 3000] + ["".join(rnd.choice(plain + odd if k % 3 == 0 else plain) for _ in range(rnd.randint(1, 50))) for k in range(n)]


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_fuzz(monkeypatch, block):
    monkeypatch.setattr(token_align, "BLOCK", block)
    some = texts(block, 1500)
    got = token_align.Alignment(pa.array(some), *token_align._sides(A, B))
    hashes, (offsets, pair, times) = got.digests(), got.pairs()
    for k, text in enumerate(some):
        a, b, groups = brute(text)
        assert (int(np.diff(got.first_a)[k]), int(np.diff(got.first_b)[k]), int(np.diff(got.first)[k])) == (len(a), len(b), len(groups)), repr(text)
        assert hashes[k] == digest(groups)
        mine = dict(zip(pair[offsets[k] : offsets[k + 1]].tolist(), times[offsets[k] : offsets[k + 1]].tolist(), strict=True))
        assert mine == Counter(x[-1] * 32000 + y[-1] for x, y in groups)


def test_counts_of_the_corpus(spark):
    _store.ship(spark)
    rows = [(k % 50 if k % 9 else None, t, "x", 1) for k, t in enumerate(texts(5, 150) + ["the same text"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n_a int").repartition(4)
    got = token_align.alignment_digests(df, A, B, keep=("doc_id", "text", "n_a")).collect()
    groups = [brute(r[1])[2] for r in rows]
    count = Counter((x[-1], y[-1]) for some in groups for x, y in some)
    best_a, best_b = Counter(), Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    want = []
    for r in rows:
        a, b, some = brute(r[1])
        links = [(x[-1], y[-1]) for x, y in some]
        best = [p for p in links if count[p] == best_b[p[1]]]
        want.append((r[0], r[1], len(a), len(b), len(some), len(links), len(best), sum(count[p] == best_a[p[0]] for p in best), sum(count[p] for p in links), digest(some)))
    have = [(r.doc_id, r.text, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_mutual, r.count_sum, r.groups_sha256) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_groups_as_columns(spark):
    _store.ship(spark)
    rows = [(k, t) for k, t in enumerate(texts(6, 30))]
    for r in token_align.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, keep=("doc_id", "text")).collect():
        a, b, groups = brute(r.text)
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [r.a_ids[i] for i in r.a_last] == [x[-1] for x, _ in groups] and [r.b_ids[i] for i in r.b_last] == [y[-1] for _, y in groups]


def test_long_text(spark):
    _store.ship(spark)
    long = ("wörd and 中" * 120_000) + "y" * 20_000 + "\n" * 20_000
    (r,) = token_align.alignment_digests(spark.createDataFrame([(1, long)], "doc_id long, text string"), A, B).collect()
    a, b, groups = brute(long)
    assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256) == (len(a), len(b), len(groups), digest(groups))


def test_empty_table(spark):
    _store.ship(spark)
    assert token_align.alignment_digests(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
