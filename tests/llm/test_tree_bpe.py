import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import _store, tree_bpe
from lodestar.llm.tree_bpe import Encoder, encoding_digests

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "th", "er", "on", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'", "'s", "'ll", "!", "***", "中", "😀", " ", "　", "\r\n", "A", "the", " of", "<|endoftext|>", "aaaaaaaa", "        ", "\u0001"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("leaf", [8, 16, 64])
def test_against_the_library(library, leaf):
    rnd, own = random.Random(leaf), Encoder(BYTE, leaf=leaf)
    texts = ["".join(rnd.choice(v) for _ in range(rnd.randint(0, 200))) for v in (rnd.sample(PARTS, rnd.choice([1, 2, 3, 6, len(PARTS)])) for _ in range(1500))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@given(st.text(max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    own = _own()
    assert own.encode([text])[0].tolist() == own.own.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode([text])[0]) == text


_made = []


def _own():
    if not _made:
        _made.append(Encoder(BYTE, leaf=16))
    return _made[0]


@pytest.mark.parametrize("text", ["x" * 20_000, "ab" * 9000, " " * 9000 + "a", "1234567890" * 2000, "'" * 9000 + "s", "!?" * 5000, "é" * 9001])
def test_long_unsplit(library, text):
    assert Encoder(BYTE, leaf=1000).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


#: White space of every kind, and characters that only some versions of Unicode count as such.
SPACES = [*" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎   ​    　﻿", "\r\n", "  "]
MORE = [*PARTS, "'r", "e", "re", "ING'''", "Thing", "ı", "ﬁ", "Σ", "ǆ", "‍", "’s", "\U0001e900", "H̱", "x", "----", "____", "77"]


@pytest.mark.parametrize("leaf", [4, 5, 7, 13, 16, 31, 64])
def test_every_white_space(library, leaf):
    rnd, own = random.Random(leaf), Encoder(BYTE, leaf=leaf)
    texts = ["".join(rnd.choice(v) for _ in range(rnd.randint(0, 80))) for v in (rnd.sample(SPACES, rnd.choice([1, 2, 5])) + rnd.sample(MORE, rnd.choice([1, 2, 5])) for _ in range(2000))]
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, ascii(text)


@pytest.mark.parametrize("left, right", [("word ", "tail "), ("word", "tail")])
def test_mixed_run_at_every_cut(library, left, right):
    core = "ıThingﬁ\U0001f468‍\U0001f469‍\U0001f467oftext|>Σǆ77\x0b\xb2\x85ING'''reINGThingΣ's's<|end \x0b\x1f’s᠎   therend"
    texts = [(left * 2000)[:pad] + core + (right * 2000)[: 8192 - pad - len(core)] for pad in range(3990, 4100)]
    for text, ids, want in zip(texts, Encoder(BYTE, leaf=4096).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids


def test_a_full_table(monkeypatch, library):
    monkeypatch.setattr(tree_bpe, "TABLE", 50)
    own, rnd = Encoder(BYTE), random.Random(2)
    for _ in range(30):
        texts = ["".join(rnd.choice("abcdef \n!") for _ in range(300)) + "y" * rnd.choice([3, 60]) for _ in range(3)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.table.hash) <= 50


def test_words_against_the_library():
    library, own, rnd = Tokenizer.from_file(WORD), Encoder(WORD, "no_space"), random.Random(5)
    parts = [*PARTS, "H̱", "É", "×", "(", ".", "_", "Word", "ÿ", "²", "7", "a7", "́", "Σ", "İ", "'S", "</w>", "<|startoftext|>"]
    texts = ["".join(rnd.choice(v) for _ in range(rnd.randint(0, 60))) for v in (rnd.sample(parts, rnd.choice([1, 2, 3, 6, len(parts)])) for _ in range(3000))]
    for text, ids in zip(texts, own.encode_words(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_digests(spark, library):
    _store.ship(spark)
    rows = [(1, "Hello world"), (2, None), (3, "naïve " * 3000)]
    for r in encoding_digests(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect():
        ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest()
