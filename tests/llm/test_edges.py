"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns of clashing names."""

import public_tokenizers
import pytest

from lodestar.llm import _store, byte_cnn, chat_fsm, ffd_packing, hilbert, lattice_lm, line_dedup, minhash, page_diff, suffix_quality, token_align, tree_bpe, wav_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, size int, key string, n string, rep string, ids string, media string, row string, c string"
LONG = "wörd " * 40_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "x" * 30_000, "en", "b"),
    (5, LONG, "de", "a"), (None, "der hund und die katze", "de", None), (None, None, None, None), (6, " \n\t ", "fr", "a"), (7, "\u0000 nul <|endoftext|> 中文 😀", "fr", ""), (1, "another text of the same id", "en", "a"),
]


def build(spark, rows):
    _store.ship(spark)
    return spark.createDataFrame([(*r, None, True, "s", 1, "k", "n", "r", "i", "m", "w", "c") for r in rows], SCHEMA)


def words(docs):
    return lattice_lm.scored(docs, public_tokenizers.path("piece_bpe_32k.model"), rounds=1)


def languages(docs):
    from pyspark.sql import functions as F

    return byte_cnn.predicted(docs, byte_cnn.fitted(docs, F.lit(True)))


def packed(docs):
    return ffd_packing.packed(_store.written(ffd_packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


OPERATORS = {
    "op1": words, "op2": suffix_quality.quality_signals, "op3": lambda d: tree_bpe.encoding_digests(d, public_tokenizers.path("byte_bpe_50k.json")), "op4": languages, "op5": hilbert.sharded, "op8": minhash.near_duplicates,
    "op10": wav_print.media_digests, "op10_columns": wav_print.media_columns, "op11": line_dedup.line_digests,
    "op13": lambda d: token_align.alignment_digests(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "op3_columns": lambda d: tree_bpe.encoded(d, public_tokenizers.path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    got = OPERATORS[name](build(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "op7"])
def test_empty_table(spark, name):
    assert (OPERATORS | {"op7": packed})[name](build(spark, [])).collect() == []


def test_packing(spark):
    got = packed(build(spark, ROWS)).collect()
    assert sum(r.start == 0 for r in got) == len(ROWS)
    assert all(r.doc_tokens == 1 and r.length == 1 for r in got if r.doc_id == 3)


def test_meaning_of_nothing(spark):
    docs = build(spark, ROWS)
    quality = {r.doc_id: r for r in suffix_quality.quality_signals(docs.where("doc_id IN (2, 3, 6)")).collect()}
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in quality.values())
    assert {r.doc_id: (r.lang_pred, r.score) for r in languages(docs).where("doc_id IN (2, 3, 6)").collect()} == {k: ("und", 0.0) for k in (2, 3, 6)}
    near = minhash.near_duplicates(docs).collect()
    assert {(r.n_shingles, r.component_id, r.kept) for r in near if r.doc_id in (2, 3, 6)} == {(0, 2, True), (0, 3, True), (0, 6, True)}
    assert all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    assert all(r.payload_bytes == 64 for r in wav_print.media_digests(docs).where("doc_id IN (2, 3)").collect())


def test_chats_and_pages(spark):
    _store.ship(spark)
    kind = "conv_id long, turn long, role string, text string, loss string, position string"
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (2, None, "assistant", LONG), (2, 1, "tool\nx\\", "<|im_end|>\\")]
    chats = spark.createDataFrame([(*r, "l", "p") for r in rows], kind)
    got = {r.conv_id: r for r in chat_fsm.chat_digests(chats).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2}
    assert got[1].problem == "turn 1: user after user" and got[2].loss_chars == len(LONG)
    assert chat_fsm.chat_digests(chats.limit(0)).collect() == [] and chat_fsm.formatted_turns(chats).count() == len(rows)
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://a/b", "", "x"), (2, "http://a/b", "<p>" + LONG, "x"), (2, "http://a/b", "<p>" + LONG, "x")], "page_id long, url string, html string, lines string")
    got = page_diff.main_text(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", len(LONG) - 1), ("2", len(LONG) - 1), ("None", 0)]
    assert page_diff.main_text(pages.limit(0)).collect() == []
