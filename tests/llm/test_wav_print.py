import hashlib
import math
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from lodestar.llm import _store, wav_print
from lodestar.llm.wav_print import BANDS, FRAME, HOP, fingerprints, load, media_columns, media_digests, payload, store


def test_round_trip():
    for data in (b"", b"a", b"x" * 64, bytes(range(256)) * 3):
        p = payload(data)
        assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(data) and load(store(p)) == p


def test_tone_peaks():
    t = np.arange(4096)
    samples = (128 + 60 * np.sin(2 * np.pi * 16 * t / FRAME) + 40 * np.sin(2 * np.pi * 40 * t / FRAME)).astype(np.uint8)
    got = fingerprints(samples)
    assert (np.diff(got) >= 0).all() and (got >> 20).max() < 4096 // HOP
    pairs = {((int(x) >> 11) & 511, (int(x) >> 3) & 255) for x in got}
    assert (16, 40) in pairs and (16, 16) in pairs


def brute(samples):
    """The transform by its sum, peaks and pairs by plain loops."""
    x = [(int(s) - 128) / 128 for s in samples]
    frames = -(-len(x) // HOP)
    x += [0.0] * ((frames + 1) * HOP - len(x))
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * n / (FRAME - 1)) for n in range(FRAME)]
    power = []
    for t in range(frames):
        y = np.array([x[t * HOP + n] * hann[n] for n in range(FRAME)])
        power.append([abs(sum(y * np.exp(-2j * np.pi * k * np.arange(FRAME) / FRAME))) for k in range(FRAME // 2 + 1)])
    loud = [[max((power[t][k], -k) for k in range(lo, hi)) for lo, hi in BANDS] for t in range(frames)]
    peak = [[loud[t][b][0] > 1e-4 and all(loud[t][b][0] >= loud[u][b][0] for u in (t - 1, t + 1) if 0 <= u < frames) for b in range(len(BANDS))] for t in range(frames)]
    found = []
    for t in range(frames):
        for gap in range(1, 4):
            if t + gap < frames:
                found += [(t << 20) | (-loud[t][a][1] << 11) | (-loud[t + gap][b][1] << 3) | gap for a in range(len(BANDS)) for b in range(len(BANDS)) if peak[t][a] and peak[t + gap][b]]
    return sorted(found)


@pytest.mark.parametrize("block", [3, 4096])
def test_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(wav_print, "BLOCK", block)
    rnd = random.Random(3)
    for size in (64, 128, 960, 3200):
        text = " ".join(rnd.choice(["the", "of", "Zug", "é"]) + str(rnd.random()) for _ in range(size))[:size]
        samples = np.frombuffer(payload(text.encode()[:size]), np.uint8)
        assert fingerprints(samples).tolist() == brute(samples)


def test_long_text():
    """50 MB in less than 1.5 GB: blocks, not the whole spectrum."""
    code = (
        "import resource, numpy as np, pyarrow as pa\nfrom lodestar.llm import wav_print as w\n"
        "raw = np.random.default_rng(1).integers(32, 127, 50_000_000, dtype=np.uint8).tobytes()\n"
        "back = w.load(w.store(w.payload(raw)))\nassert len(w.fingerprints(np.frombuffer(back, np.uint8)))\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True).stdout) < 1_500_000


def test_digests(spark):
    _store.ship(spark)
    text = "naïve text " * 50
    rows = [(1, text), (2, text), (3, text + "!"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in media_digests(df).collect()}
    p = payload(text.encode())
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1][1:] == got[2][1:] and got[1].media_sha256 != got[3].media_sha256
    kept = {r.doc_id: r for r in media_columns(df).collect()}
    assert hashlib.sha256(bytes(kept[1].media)).hexdigest() == got[1].media_sha256
    assert hashlib.sha256(np.array(kept[1].prints, "<i8").tobytes()).hexdigest() == got[1].feature
