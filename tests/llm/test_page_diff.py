import random
import time

from lodestar.llm import _store
from lodestar.llm import page_diff
from lodestar.llm.page_diff import MARKED, SURE, UNCLEAR, lines_of, main_text, neighbours, shared_lines


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_against_brute_force():
    rnd = random.Random(2)
    for _ in range(1500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        shared = shared_lines(a, b)
        rest = iter(b)
        assert len(shared) == longest(a, b) and all(any(x == y for y in rest) for x in [a[k] for k in sorted(shared)])


def test_alignment_of_long_pages(monkeypatch):
    monkeypatch.setattr(page_diff, "ROW_BITS", 4)
    test_alignment_against_brute_force()


def article(page):
    return [(line, kind) for line, kind in lines_of(page) if kind != MARKED]


def test_lines():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>x</ul></nav><div class="cookie-notice"><p>we use</p></div>
    <article><h1>Head &amp; tail</h1><p>one   <b>bo</b>ld<br>two&nbsp;three<p>four<script>var t = "</p>";</script></p><!-- no --><aside>side</aside><form><input><p>mail</p></form>
    <ul><li>five<li>six</ul><section id="comments"><p>first!</p></section></article><div class="sidebar">s</div><footer>&copy; us</footer></body></html>"""
    assert article(page) == [(x, SURE) for x in ("Head & tail", "one bold two three", "four", "five", "six")]
    assert [x for x, kind in lines_of(page) if kind == MARKED] == ["Site", "x", "we use", "side", "mail", "first!", "s", "\xa9 us"]
    assert lines_of("<article><p>cut &am") == [("cut &am", SURE)]
    assert lines_of('<p>one <span class="ad">buy <b>now</b></span>two</p>') == [("buy now", MARKED), ("one two", UNCLEAR)]
    assert lines_of('<p title="x>hello</p>') == [("hello", UNCLEAR)]
    assert lines_of("") == []


def test_differencing(spark):
    _store.ship(spark)
    page = lambda *own: "<div><p>Top of the site</p></div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Read more</div><div>All rights</div>"
    rows = [
        (1, "http://h.org/a/1", page("alpha", "beta")), (2, "https://h.org/a/2?x=1", page("gamma", "delta")), (3, "http://other.org/x", page("kept whole")),
        (4, "http://c.org/1", "<p>a</p><p>b</p><p>c</p>"), (5, "http://c.org/2", "<p>a</p><p>b</p><p>c</p>"),
        (6, "http://m.org/1", "<article><p>licence</p><p>mine</p></article><div>menu</div>"), (7, "http://m.org/2", "<article><p>licence</p><p>yours</p></article><div>menu</div>"), (8, None, None),
    ]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "alpha\nbeta", 2: "gamma\ndelta", 3: "Top of the site\nkept whole\nRead more\nAll rights", 4: "a\nb\nc", 5: "a\nb\nc", 6: "licence\nmine", 7: "licence\nyours", 8: ""}


def test_wrappers_and_comments():
    page = '<div class="content has-sidebar"><main><header>Site</header><article class="post"><header><h1>T</h1></header><p>x</p></article><div class="comments"><article><p>c</p></article></div></main></div>'
    assert article(page) == [("T", SURE), ("x", SURE)]
    assert article('<div class="comments"><article><p>c</p></article></div><p class="ad">x</p><div class="page-header">h</div><p>body</p>') == [("body", UNCLEAR)]


def test_deep_pages():
    began = time.process_time()
    for name in ("div", "b", "span><p", "li", "article"):
        assert lines_of(f"<{name}>" * 40_000 + "x" + f"</{name}>" * 40_000)
    assert lines_of("<b>" * 20_000 + "<p>x</p>" * 20_000) and lines_of("<div>" + "</p></b>" * 40_000 + "x")
    assert time.process_time() - began < 20


def test_neighbours_across_ranges(spark):
    rnd = random.Random(4)
    rows = [(k, "big" if k % 3 else f"h{rnd.randint(0, 9)}", f"/{rnd.randint(0, 40)}", None if k % 7 == 0 else "u", k % 5, True) for k in range(400)]
    got = {r.key: r.other for r in neighbours(spark.createDataFrame(rows, "key long, host string, path string, url string, page_id long, outside boolean")).collect()}
    rows.sort(key=lambda r: (r[1], r[2], r[3] or "", r[4], r[0]))
    want = {}
    for k, r in enumerate(rows):
        near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][1] == r[1]]
        want[r[0]] = near[0][0] if near else None
    assert got == want
