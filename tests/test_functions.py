import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, keys, similarity, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.select("k", fn(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def test_text(spark):
    assert column(spark, ["  a b ", "", None], text.trimmed) == ["a b", "", None]
    assert column(spark, ["a  b\t\tc", "a b"], text.collapsed) == ["a b c", "a b"]
    broken = "São".encode().decode("latin-1")
    assert column(spark, [broken, "São", "Ã", "中Ã£", None], text.repaired_encoding) == ["São", "São", "Ã", "中Ã£", None]
    assert column(spark, [" Açúcar & Cia. ", "x", None], text.normal_key) == ["acucar e cia", "x", None]


def test_decimals(spark):
    got = column(spark, ["1.234,56", "-7,5", "1234.5", "x", " ", None, "1.234.567,00"], text.parsed_decimal)
    assert [(r.num, r.parse) for r in got] == [(1234.56, "ok"), (-7.5, "ok"), (1234.5, "ok"), (None, "not_numeric"), (None, "empty"), (None, "empty"), (1234567.0, "ok")]


def test_dates(spark):
    got = column(spark, ["31/12/2019", "2019-12-31", "3/4/2019", "31/02/2019", "", None, "1901-01-01", "15/06/85"], lambda c: dates.parsed_date(c, "d/M/yyyy", 2024))
    assert [(r.iso, r.parse, r.ambiguous) for r in got] == [
        ("2019-12-31", "ok", False), ("2019-12-31", "ok", False), ("2019-04-03", "ok", True), (None, "unknown_format", False), (None, "empty", False), (None, "empty", False), (None, "out_of_window", False), ("1985-06-15", "ok", False),
    ]
    assert column(spark, ["2020-05-06", "", None, "1990-01-01", "x"], lambda c: dates.date_key(c, "2016-01-01")) == [20200506, -5, -5, -7, -5]


@pytest.mark.parametrize(("period", "years", "want"), [("2024-01", 0, "2023-12"), ("2024-Q1", 0, "2023-Q4"), ("2024-H2", 0, "2024-H1"), ("2024", 0, "2023"), ("2024-03", 1, "2023-03"), ("2024-11", 0, "2024-10")])
def test_previous_period(period, years, want):
    assert dates.previous_period(period, years) == want


def test_redaction(spark):
    assert column(spark, ["mail a.b@c.org or @someone", "call +55 11 98765-4321", "id 123.456.789-09", "order 12345678", "plain", None], text.redacted) == ["mail [email] or [handle]", "call [phone]", "id [id]", "order [number]", "plain", None]


def brute_scores(a, b):
    """The four rules by plain loops over the words."""
    stop = ("and", "da", "de", "do", "e", "of", "the")
    plain = lambda v: " ".join(re.sub(r"[\s.&]+", " ", unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()).split())
    x, y = ([w for w in plain(v).split() if w not in stop] for v in (a, b))
    out = {"sequence": SequenceMatcher(None, plain(a), plain(b)).ratio(), "initials": 0.0, "prefix": 0.0, "words": 0.0}
    if len(x) == 1 and len(y) > 1:
        initials = "".join(w[0] for w in y)
        out["initials"] = 0.97 if x[0] == initials else 0.85 if len(x[0]) > 1 and initials.startswith(x[0]) else 0.0
    if x and len(x) == len(y):
        if len(x) == 1:
            s, t = sorted((x[0], y[0]), key=len)
            out["prefix"] = (0.90 if len(s) > 3 else 0.82) if len(s) > 2 and t.startswith(s) else 0.0
        else:
            hits = sum(len(s) > 2 and t.startswith(s) for s, t in zip(x, y))
            out["prefix"] = 0.93 if hits == len(x) else 0.55 + 0.2 * hits / len(x) if hits else 0.0
    if set(x) & set(y):
        out["words"] = max(len(set(x) & set(y)) / len(set(x) | set(y)), 0.8 if set(x) <= set(y) or set(y) <= set(x) else 0.0)
    return out


def test_similarity(spark):
    names = ["CS", "Customer Service", "Customer Service Desk", "Eng", "Engineering", "Regi. Oper.", "Regional Operations", "People & Culture", "People", "", "of the", "São Paulo", "Sao", "Cust Serv North", "R&D", "C"]
    rows = [(a, b) for a in names for b in names]
    best = similarity.similarity(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", best.alias("s")).collect()
    for r in got:
        want = brute_scores(r.a, r.b)
        top = max(want.values())
        assert r.s.score == pytest.approx(top), (r.a, r.b)
        assert r.s.method == (next(k for k, v in want.items() if v == top) if top else "none"), (r.a, r.b)
    none = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string").select(best.alias("s")).collect()
    assert {(r.s.score, r.s.method) for r in none} == {(0.0, "none")}


def plain_names(value, allow, openers, mark="[name]"):
    """Names by a walk over characters: tokens of letters and of anything else."""
    tokens, kind = [], None
    for k, c in enumerate(value):
        joins = c in "'’-" and kind == "w" and k + 1 < len(value) and value[k + 1].isalpha()
        now = "w" if c.isalpha() or joins else "s" if c.isspace() else "x"
        if tokens and now == kind:
            tokens[-1] += c
        else:
            tokens.append(c)
        kind = now
    allowed = [text.slug_of(t).split() for t in allow]
    capital = lambda w: w[0].isalpha() and w[0].isupper() and not w.isupper()
    k, out = 0, []
    while k < len(tokens):
        if not capital(tokens[k]):
            out.append(tokens[k])
            k += 1
            continue
        words, j = [k], k
        while True:
            small, i = 0, j
            while i + 2 < len(tokens) and tokens[i + 1].isspace() and tokens[i + 2] in text.PARTICLES and small < 2:
                small, i = small + 1, i + 2
            if not (i + 2 < len(tokens) and tokens[i + 1].isspace() and capital(tokens[i + 2])):
                break
            j = i + 2
            words.append(j)
        while words and tokens[words[0]].lower() in openers:
            words = words[1:]
        told = [w for x in words for w in text.slug_of(tokens[x]).split()]
        safe = any(term[i : i + len(told)] == told for term in allowed for i in range(len(term)))
        if len(words) < 2 or safe:
            out += tokens[k : j + 1]
        else:
            out += [*tokens[k : words[0]], mark]
        k = j + 1
    return "".join(out)


def test_names_and_slugs(spark):
    hide = lambda c: text.without_names(text.redacted(c), ("Customer Service Desk",), ("quem",))
    values = ["ask Maria da Silva or John Smith", "the Customer Service", "Quem Sabe", "Plain text", "Ána Müller x@y.org", None, "", "Quem John Smith", "John, Smith", "Ana de la Cruz e Rui", "USA Today NASA", "Jean-Luc O'Neil", "Service Desk Smith"]
    want = ["ask [name] or [name]", "the Customer Service", "Quem Sabe", "Plain text", "[name] [email]", None, "", "Quem [name]", "John, Smith", "[name]", "USA Today NASA", "[name]", "[name]"]
    assert column(spark, values, hide) == want
    assert [v and plain_names(v, ("Customer Service Desk",), ("quem",)) for v in want] == want
    assert column(spark, ["Ação & Co.", "--", None], text.slug) == ["acao co", "", None]


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_numbered(spark, rows):
    df = spark.createDataFrame([(float(k % 13), k) for k in range(100)] + [(None, 100), (None, 101)], "x double, k int")
    got = keys.numbered(df, "x", "n", ("k",), rows=rows).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 103))
    assert [(r.x, r.k) for r in got] == sorted([(r.x, r.k) for r in got], key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def test_names_of_whole_texts(spark):
    """Every document of the small table, and joined pieces of random words, against plain loops."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rnd = random.Random(4)
    words = ["Ana", "de", "da", "Rui", "THE", "The", "customer", "Customer", "Service", "O'Neil", "x-Y", "É", "Él", "9", "A1b", "von", "-", "'"]
    made = spark.createDataFrame([("".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", ", ", ""]) for _ in range(20)),) for _ in range(400)], "text string")
    clean = docs.union(made).select(text.redacted(F.col("text")).alias("text"))
    allow, openers = ("Customer Service", "Apache License"), ("the", "in")
    got = clean.select("text", text.without_names(F.col("text"), allow, openers).alias("out")).collect()
    assert [r.out for r in got] == [None if r.text is None else plain_names(r.text, allow, openers) for r in got]
