import random

import pytest

from lodestar.llm import _store, minhash
from lodestar.llm.minhash import components, near_duplicates


def sets(rows, n=5):
    out = {}
    for k, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s[k]), find(k), find(k) == k) for k in ids}


def corpus(seed):
    """Copies, chains, a hub whose copies are only linked through it, a passage that many share, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    texts = []
    hub = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(hub)
        for _ in range(2):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    chain = [word() for _ in range(200)]
    for _ in range(15):
        chain = list(chain)
        chain[rnd.randrange(200)] = word()
        texts.append(" ".join(chain).title())
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rnd.randint(5, 30))]) for _ in range(60)]
    texts += ["One two", "one TWO", "one two three", "", None, " ", *([texts[3]] * 5), *(" ".join(word() for _ in range(50)) for _ in range(40))]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 7)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    _store.ship(spark)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "GROUP", 9)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    for n, m in ((30, 20), (200, 180), (50, 0)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(300, 340)] if m else [])
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, c long")).collect()}
        assert all(got.get(k, k) == find(k) for k in root)
