import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm.hilbert import curve_index, sharded


def test_curve_visits_neighbours(spark):
    n = F.col("id")
    cells = spark.range(32768).select((n % 32).cast("int").alias("x"), (F.floor(n / 32) % 32).cast("int").alias("y"), F.floor(n / 1024).cast("int").alias("z"))
    way = cells.select("x", "y", "z", curve_index(F.col("x"), F.col("y"), F.col("z")).alias("h")).orderBy("h").collect()
    assert [r.h for r in way] == list(range(32768))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(way, way[1:], strict=False))


@pytest.mark.parametrize(("rows", "bucket"), [(500, 50_000), (500, 7), (13, 3), (0, 5)])
def test_law_of_rows(spark, rows, bucket):
    rnd = random.Random(rows)
    data = [(k, "é" * rnd.randint(0, 300), rnd.choice(["en", "de", None]), "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 60)}") for k in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = sharded(df, bucket_rows=bucket).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    texts = {d[0]: d[1].encode() for d in data}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(40)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_buckets_do_not_change_the_order(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharded(df, bucket_rows=n).collect()} for n in (11, 10_000))
    assert a == b
