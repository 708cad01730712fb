import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm import _store
from lodestar.llm.ffd_packing import first_fit, packed, token_pieces

WORD = public_tokenizers.path("word_bpe_49k.json")


def brute(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        k = next((k for k, used in enumerate(bins) if used + s <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((k, bins[k]))
        bins[k] += s
    return out


def test_tree_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 60))]
        got = first_fit(np.array(sizes), 20)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == brute(sizes, 20)


def test_every_token_once(spark):
    _store.ship(spark)
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(["The", "fox,", "über"]) for _ in range(rnd.choice([0, 3, 40, 900, 5000])))) for k in range(120)]
    cut = _store.written(token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), WORD, with_ids=True), "p")
    got = packed(cut, group_rows=50).collect()
    library = Tokenizer.from_file(WORD)
    for k, text in rows:
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*library.encode(text, add_special_tokens=False).ids, 2]
        assert all(r.doc_tokens == sum(x.length for x in own) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in got) / (4096 * len(by)) > 0.9


def test_equal_rows_part(spark):
    _store.ship(spark)
    rows = _store.written(spark.range(5000).selectExpr("cast(null as bigint) AS doc_id", "0L AS start", "7L AS length", "5L AS ids_crc32", "7L AS doc_tokens"), "equal")
    got = packed(rows, group_rows=500).collect()
    groups = [r.sequence_id >> 32 for r in got]
    assert len(got) == 5000 and max(map(groups.count, set(groups))) < 800
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
