"""What differencing decides: lines outside articles, short articles in long templates, groups of copies."""

from lodestar.llm import _store
from lodestar.llm.page_diff import main_text


def texts(spark, rows):
    _store.ship(spark)
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_lines_outside_articles(spark):
    page = lambda own, after: f"<div>Start</div><article><p>Licence</p><p>{own}</p></article><p>{after}</p><div>All rights</div>"
    got = texts(spark, [(1, "http://m.org/1", page("mine", "Postscript")), (2, "http://m.org/2", page("yours", "Errata"))])
    assert got == {1: "Licence\nmine\nPostscript", 2: "Licence\nyours\nErrata"}


def test_differencing_without_marks(spark):
    """Menus and footers that pages of a host share go by differencing alone; what is new on each page goes by its marks."""
    _store.ship(spark)
    page = lambda own, ad: f"<nav><ul><li>Home</li><li>News</li></ul></nav><div class='ad'>{ad}</div><article><p>Licence</p><p>{own}</p></article><footer>All rights</footer>"
    rows = spark.createDataFrame([(k, f"http://m.org/{k}", page(f"own {k}", f"buy {k}")) for k in range(6)], "page_id long, url string, html string")
    bare = {r.page_id: (r.text, r.shared_lines, r.marked_lines) for r in main_text(rows, marks=False).collect()}
    assert bare == {k: (f"buy {k}\nLicence\nown {k}", 3, 0) for k in range(6)}
    full = {r.page_id: (r.text, r.shared_lines, r.marked_lines) for r in main_text(rows).collect()}
    assert full == {k: (f"Licence\nown {k}", 3, 1) for k in range(6)}


def test_short_articles_and_copies(spark):
    page = lambda *own: "".join(f"<p>{x}</p>" for x in (*(f"Menu {k}" for k in range(12)), *own, *(f"Foot {k}" for k in range(8))))
    rows = [
        (1, "http://t.org/1", page("a", "b", "c")), (2, "http://t.org/2", page("d", "e", "f")),
        (3, "http://k.org/1", page("g", "h")), (4, "https://k.org/1", page("g", "h")), (5, "http://k.org/1?x=1", page("g", "h")), (6, "http://k.org/2", page("i")), (7, "http://k.org/0", ""),
        (8, "http://c.org/1", "<p>x</p>"), (9, "http://c.org/2", "<p>x</p>"),
    ]
    assert texts(spark, rows) == {1: "a\nb\nc", 2: "d\ne\nf", 3: "g\nh", 4: "g\nh", 5: "g\nh", 6: "i", 7: "", 8: "x", 9: "x"}
