"""Language ID by a byte convolutional network in numpy.

Windows of ``width`` bytes; each byte becomes a small vector; filters of several widths run over them; the largest
response of each filter goes to a softmax over the languages. A text's windows, all of them, are rated in batches and
their logits averaged by the bytes they hold. The score is the softmax of that average at the predicted language.

The network is trained in one task on a bounded sample of labelled rows: at most ``sample_rows`` rows by a hash of
their id and text, three windows of each. The sample is drawn label by label, so that a rare language has as many rows as
a frequent one or all that it has; no label is left out while there are fewer labels than rows of the sample, beyond which
the most frequent are learned. Every row is predicted, a very long text window by window in bounded memory. A null text or
one without a letter is ``und`` with score 0; so is every text if there was nothing to learn from; an empty table has no
rows. Of languages with equal scores the first by name counts. Repeated rows have one language and scores that are
equal but for rounding in single precision, as the batch that a window is in sets the order of sums. Other columns are not
looked at, whatever they are called.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import annotated, bytes_of
from ._words import _ramp

FILTER_WIDTHS, FILTERS, VECTOR = (2, 3, 4), 16, 8
_LETTER = re.compile(r"[^\W\d_]")


class Net:
    def __init__(self, labels: list[str], width: int = 256, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.width = labels, width
        self.p = {"byte": rng.normal(0, 0.5, (256, VECTOR))}
        for k in FILTER_WIDTHS:
            self.p[f"filter{k}"] = rng.normal(0, (1 / (k * VECTOR)) ** 0.5, (k * VECTOR, FILTERS))
            self.p[f"bias{k}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(FILTER_WIDTHS) * FILTERS, len(labels)))
        self.p["base"] = np.zeros(len(labels))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray, k: int) -> np.ndarray:
        n, size, _ = x.shape
        rows, step, one = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, size - k + 1, k * VECTOR), (rows, step, one))).reshape(-1, k * VECTOR)

    def features(self, windows: np.ndarray, back: dict | None = None) -> np.ndarray:
        x = self.p["byte"][windows]
        out = []
        for k in FILTER_WIDTHS:
            columns = self._columns(x, k)
            got = (columns @ self.p[f"filter{k}"]).reshape(len(x), -1, FILTERS)
            if back is None:
                out.append(np.maximum(got.max(1) + self.p[f"bias{k}"], 0))
                continue
            at = got.argmax(1)
            top = np.take_along_axis(got, at[:, None], 1)[:, 0] + self.p[f"bias{k}"]
            back[k] = (columns.reshape(len(x), -1, k * VECTOR), at, top > 0)
            out.append(np.maximum(top, 0))
        return np.concatenate(out, 1)

    def logits(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = [self.features(windows[lo : lo + batch]) @ self.p["out"] + self.p["base"] for lo in range(0, len(windows), batch)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 1) -> None:
        """Adam on the cross-entropy, classes weighted to count alike."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1)))[y].astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                at = order[lo : lo + batch]
                grads = self._gradients(windows[at], y[at], weight[at])
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def _gradients(self, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        back: dict = {}
        f = self.features(windows, back)
        z = f @ self.p["out"] + self.p["base"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None] / len(y)
        grads = {"out": f.T @ d, "base": d.sum(0)}
        df = d @ self.p["out"].T
        byte = np.zeros_like(self.p["byte"])
        rows = np.arange(len(y))[:, None]
        for n, k in enumerate(FILTER_WIDTHS):
            columns, at, on = back[k]
            own = df[:, n * FILTERS : (n + 1) * FILTERS] * on
            picked = columns[rows, at]
            grads[f"filter{k}"] = np.einsum("nf,nfc->cf", own, picked)
            grads[f"bias{k}"] = own.sum(0)
            into = own[:, :, None] * self.p[f"filter{k}"].T[None]
            for j in range(k):
                np.add.at(byte, windows[rows, at + j].ravel(), into[:, :, j * VECTOR : (j + 1) * VECTOR].reshape(-1, VECTOR))
        return grads | {"byte": byte}


def windows_of(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows filled with zeros, the text of each, the bytes in each); an empty text has none."""
    size = np.diff(at)
    many = -(-size // width)
    doc = np.repeat(np.arange(len(size)), many)
    nth = _ramp(many)
    held = np.minimum(size[doc] - nth * width, width)
    out = np.zeros((len(doc), width), np.uint8)
    start = at[:-1][doc] + nth * width
    full = held == width
    if full.any():
        out[full] = raw[start[full][:, None] + np.arange(width)]
    for k in np.flatnonzero(~full).tolist():
        out[k, : held[k]] = raw[start[k] : start[k] + held[k]]
    return out, doc, held


def fitted(docs: DataFrame, train: Column, doc: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 3000, width: int = 256) -> Net | None:
    """A network trained on at most ``sample_rows`` of the rows with ``train`` and a label; None if there are none."""
    named = docs[label].cast("string")
    rows = docs.where(train & docs[label].isNotNull() & docs[text].isNotNull())
    counts = rows.groupBy(named.alias("label")).count().orderBy(F.desc("count"), "label").limit(sample_rows).collect()
    if not counts:
        return None
    shares, left = [], sample_rows
    for k, row in enumerate(reversed(counts)):  # what rare labels leave goes to the others
        quota = min(row["count"], left // (len(counts) - k))
        left -= quota
        shares.append((row["label"], min(1 << 20, max(1, int(0.9 * quota / row["count"] * (1 << 20)))) if quota < row["count"] else 1 << 20))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), named)
    drawn = rows.where(F.pmod(F.xxhash64(docs[doc], docs[text]), F.lit(1 << 20)) < share)
    body, size = docs[text], F.length(docs[text])
    places = [F.lit(1), F.greatest(F.lit(1), (size * 0.4).cast("int")), F.greatest(F.lit(1), (size * 0.8).cast("int"))]
    parts = [F.substring(body, p, F.lit(width)).alias(f"w{k}") for k, p in enumerate(places)]
    sample = drawn.select(named.alias("label"), *parts).limit(sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in batch.to_pylist()]
        labels = sorted({r["label"] for r in got})
        rng = np.random.default_rng(3)
        windows, y = [], []
        for r in sorted(got, key=lambda r: tuple(r.values())):
            for k in range(3):
                raw = np.frombuffer(r[f"w{k}"].encode()[:width], np.uint8)
                if k == 2:
                    raw = raw[: rng.integers(8, width)]  # short texts too
                if len(raw):
                    windows.append(np.pad(raw, (0, width - len(raw))))
                    y.append(labels.index(r["label"]))
        if y:
            net = Net(labels, width)
            net.train(np.array(windows), np.array(y), epochs=max(8, min(100, 32_000 // len(y))))  # small samples more often
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    got = sample.mapInArrow(learn, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def predicted(df: DataFrame, net: Net | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep`` of each row with lang_pred and score."""
    given = df.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable[[pa.Array], dict]:
        own = given.value

        def run(texts: pa.Array) -> dict:
            raw, at = bytes_of(texts)
            letters = np.array([bool(_LETTER.search(t)) for t in pc.fill_null(texts, "").to_pylist()], bool)
            label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if own is not None and letters.any():
                windows, doc, held = windows_of(raw, at, own.width)
                total = np.zeros((len(texts), len(own.labels)))
                np.add.at(total, doc, own.logits(windows) * held[:, None])
                total /= np.maximum(np.diff(at), 1)[:, None]
                total = np.exp(total - total.max(1, keepdims=True))
                total /= total.sum(1, keepdims=True)
                best = total.argmax(1)
                label[letters] = np.array(own.labels, object)[best[letters]]
                score[letters] = total[np.arange(len(best)), best][letters]
            return {f"{prefix}lang_pred": label.tolist(), f"{prefix}score": score}

        return run

    return annotated(df, text, list(keep), make, f"{prefix}lang_pred string, {prefix}score double")
