import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import _store, registry
from tests.llm.test_near_stage import kept

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on its own input, and the whole against the stages one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    good = _store.written(corpus_pipeline.quality(spark, docs, DATA), "t1")
    want = {r.doc_id for r in registry.op2_suffix_quality(spark, DATA).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want
    told = _store.written(corpus_pipeline.language(spark, good, DATA), "t2")
    assert told.columns == docs.columns and {r.doc_id for r in told.collect()} <= want and told.count() > 0.95 * len(want)
    apart = _store.written(corpus_pipeline.near_duplicates(spark, told, DATA), "t3")
    assert {r.doc_id for r in apart.collect()} == kept([(r.doc_id, r.text) for r in told.collect()], 80)
    pieces = corpus_pipeline.packing(spark, apart, DATA).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in apart.collect():
        assert sum(p.length for p in pieces if p.doc_id == r.doc_id) == len(library.encode(r.text, add_special_tokens=False).ids) + 1


CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fingerprint string, n_shingles int, component_id long, lang_pred string, score double, `row` string, start int"
WORDS = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"other{k}" for k in range(60))


def rows(spark, data):
    _store.ship(spark)
    return spark.createDataFrame([(*d, "s", 1, None, "f", 1, 2, "x", 0.5, "r", 3) for d in data], CLASH)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, rows(spark, []), "").collect() == []
    docs = rows(spark, [(None, None, None), (1, None, None), (2, "", "en"), (None, WORDS, None), (3, " \n", "en"), (4, "x" * 50_000, None)])
    got = stage(spark, docs, "").collect()
    if name != "packing":
        assert got == [] or got[0].__fields__ == docs.columns
        assert {r.doc_id for r in got} <= {None, 1, 2, 3, 4}
    if name == "near_duplicates":
        assert len(got) == 6


def test_rows_that_share_an_id(spark):
    docs = rows(spark, [(0, WORDS, "en"), (1, WORDS, "en"), (1, OTHER, "en"), (1, OTHER, "en"), (2, OTHER, None), (5, "short", "en"), (5, "short", "en"), (None, WORDS, "en"), (6, None, "en")])
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("0", WORDS), ("1", OTHER), ("5", "short"), ("None", WORDS), ("6", None)], key=lambda r: (r[0], r[1]))


def test_language_fills_labels(spark):
    docs = rows(spark, [(k, "the and of to in is that for was on " * 9, None if k % 5 == 0 else "en") for k in range(30)] + [(100 + k, "der die und das ist nicht ein zu von mit " * 9, "de" if k % 5 else None) for k in range(30)] + [(200, "12345 !!", "en")])
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {k: "en" for k in range(30)} | {100 + k: "de" for k in range(30)}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(corpus_pipeline.language(spark, bare, "").collect()) == sorted(bare.collect())


def test_nothing_is_left_on_executors(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert corpus_pipeline.near_duplicates(spark, rows(spark, [(0, WORDS, "en"), (1, WORDS, "en"), (2, OTHER, "en")]), "").count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
