import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import _store, registry
from lodestar.llm._batches import bytes_of
from lodestar.llm.byte_cnn import Net, fitted, predicted, windows_of

DATA = "/root/testdata/sf0.001"


def test_windows_hold_every_byte():
    raw, at = bytes_of(pa.array(["a" * 600, None, "", "é", "b" * 256]))
    windows, doc, held = windows_of(raw, at, 256)
    assert doc.tolist() == [0, 0, 0, 3, 4] and held.tolist() == [256, 256, 88, 2, 256]
    assert b"".join(w[:h].tobytes() for w, h in zip(windows, held, strict=True)) == raw.tobytes()


def test_gradients():
    net, rng = Net(["x", "y", "z"], width=12, seed=3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, y, weight = rng.integers(0, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones(5)

    def loss():
        z = net.features(windows) @ net.p["out"] + net.p["base"]
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(5), y]))

    grads = net._gradients(windows, y, weight)
    for name in ("filter2", "filter4", "bias3", "out", "base", "byte"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-6
        up = loss()
        net.p[name][at] = kept - 1e-6
        assert abs((up - loss()) / 2e-6 - grads[name][at]) < 1e-4
        net.p[name][at] = kept


def test_forward_against_loops():
    """Byte vectors, filters, largest response, softmax over the average of windows, by plain loops."""
    net, rng = Net(["x", "y", "z"], width=16, seed=5), np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, 16)).astype(np.uint8)
    for w, got in zip(windows, net.logits(windows), strict=True):
        features = []
        for k in (2, 3, 4):
            for f in range(16):
                best = max(sum(float(net.p["byte"][w[t + j]][v]) * float(net.p[f"filter{k}"][j * 8 + v][f]) for j in range(k) for v in range(8)) for t in range(16 - k + 1))
                features.append(max(best + float(net.p[f"bias{k}"][f]), 0.0))
        want = [sum(x * float(net.p["out"][i][c]) for i, x in enumerate(features)) + float(net.p["base"][c]) for c in range(3)]
        assert np.allclose(got, want, atol=1e-4)


def test_average_of_windows_against_loops(spark):
    """Each text's windows weigh by the bytes they hold, the last one too; a text without a letter is not told."""
    _store.ship(spark)
    net, rng = Net(["x", "y", "z"], width=16, seed=5), np.random.default_rng(2)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (1, 15, 16, 17, 32, 33, 200, 5000)] + ["é" * 21, "12 34", "", None]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(99, texts[3], "clash")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predicted(spark.createDataFrame(rows, "doc_id long, text string, score string"), net).collect()}
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert got[k] == ("und", 0.0)
            continue
        raw = np.frombuffer(t.encode(), np.uint8)
        mean = sum(net.logits(np.pad(w, (0, 16 - len(w)))[None])[0] * len(w) for w in (raw[i : i + 16] for i in range(0, len(raw), 16))) / len(raw)
        share = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[k][0] == net.labels[share.argmax()] and abs(got[k][1] - share.max()) < 1e-5
    assert got[99][0] == got[3][0] and abs(got[99][1] - got[3][1]) < 1e-6


def test_no_label_is_left_out(spark):
    _store.ship(spark)
    docs = spark.createDataFrame([(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 5} " * 12, f"l{k:03}") for k in range(230)], "doc_id long, text string, lang string")
    assert fitted(docs, F.lit(True)).labels == [f"l{k:03}" for k in range(230)]


def test_rare_labels_are_learned(spark):
    _store.ship(spark)
    data = [(k, "the and of to in " * 20, "en") for k in range(600)] + [(1000 + k, "qqq www zzz xxx " * 20, "rare") for k in range(6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = fitted(docs, F.lit(True), sample_rows=60)
    assert net.labels == ["en", "rare"]
    assert {(r.doc_id > 900, r.lang_pred) for r in predicted(docs, net).collect()} == {(False, "en"), (True, "rare")}


def test_held_out_accuracy(spark):
    _store.ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = registry.op4_byte_cnn(spark, DATA).join(docs, "doc_id").where("held_out AND lang_pred <> 'und' AND length(text) > 100")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert right.a >= 0.9 and 0 <= right.lo <= right.hi <= 1
