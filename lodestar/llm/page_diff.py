"""HTML extraction with nearest-URL page differencing.

A page becomes its lines, the blocks of visible text in order. Each page is paired with the page next to it by URL path
within its host, both pages' lines are aligned by longest common subsequence, and lines that both share are deleted,
but for lines inside an article (or main) element, which are the page's own: passages that two articles share belong to
both. What differencing leaves outside the article goes too if elements, roles or class names mark it as a menu, header,
footer, sidebar, notice, advert, form or reader comment, as such lines may be new on every page. Scripts and styles are
no visible text. ``shared_lines`` and ``marked_lines`` say how many lines went by which of the two.

Pages of a host with the same lines are copies: one of them, the first by URL, stands for all in the order, so that a
copy meets a page of other lines; pages without lines are no neighbours. A host whose pages are all copies has nothing to
compare. Pages that differ in a few lines are no copies. Only hashes of lines go through the sort by URL, in ranges that a
host's pages share out, and through the alignment, once for all copies; the lines themselves are read from the pages again
when the decisions are known. A null page is empty; a null URL counts as an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._batches import pieces
from ._store import bounded, written

#: A comment, character data, a declaration, a tag, or a tag with a quote that never ends, which goes up to the next >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?:(?P<in>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^>]*(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements whose content is no text at all, up to their end tag.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "xmp"}
#: Elements that are no part of the article.
_DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "head", "svg", "canvas", "object", "dialog", "fieldset", "label"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _DROP
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end where the next of their kind begins.
_AUTO = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class names and ids of what is no part of the article.
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "disclaimer", "copyright",
    "skip", "social", "share", "sharing", "related", "recommended", "widget", "login", "search", "searchbox", "toolbar", "pagination", "pager", "masthead", "topbar",
}
_OUTER = {"header"}
#: What is said of a line: the page's own, not told, or marked as no part of the article.
SURE, UNCLEAR, MARKED = range(3)
_COMMENTS = {"comment", "comments", "commentlist", "respond", "replies", "disqus"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _dropped(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """2 if the element is no part of the article whatever it holds, 1 if only its names say so, else 0."""
    words = set(_name_words(attributes))
    if words & _COMMENTS:
        return 2
    if name in ("html", "body", "article", "main") or (name == "header" and in_article):
        return 0
    if name in _DROP or attributes.get("role", "").lower() in _ROLES:
        return 2
    return int(bool(words & _NAMES) or (not in_article and bool(words & _OUTER)))


def _name_words(attributes: dict[str, str]) -> list[str]:
    return re.findall(r"[a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())


class _Open:
    """The open elements; each look at them takes constant time, however deep they are."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, dropped, in an article or main element
        self.at: dict[str, list[int]] = {}
        self.blocks, self.stops = [0], [0]  # places of block elements, and of those that end the reach of a paragraph

    def push(self, name: str, dropped: int, inside: bool) -> None:
        k = len(self.stack)
        self.stack.append((name, dropped, inside))
        self.at.setdefault(name, []).append(k)
        if name in _BLOCK:
            self.blocks.append(k)
            if name != "p":
                self.stops.append(k)

    def last(self, name: str) -> int:
        """The place of the innermost element of this name, or 0."""
        found = self.at.get(name)
        return found[-1] if found else 0

    def pop(self, to: int) -> None:
        """Closes the elements from a place on."""
        while len(self.stack) > to:
            name = self.stack.pop()[0]
            self.at[name].pop()
        for places in (self.blocks, self.stops):
            while places[-1] >= to:
                places.pop()


def lines_of(html: str) -> list[tuple[str, int]]:
    """(line, SURE in an article or main element, else MARKED or UNCLEAR) of each block of visible text."""
    out: list[tuple[str, int]] = []
    opened = _Open()
    text: list[str] = []
    lost: list[str] = []  # of elements that are no part of the article, also of those inside a line

    def take(parts: list[str], kind: int) -> None:
        line = " ".join(unescape("".join(parts)).split()) if parts else ""
        if line:
            out.append((line, kind))
        parts.clear()

    def close_line() -> None:
        take(lost, MARKED)
        take(text, SURE if opened.stack[-1][2] else UNCLEAR)

    def pop(to: int) -> None:
        if opened.blocks[-1] >= to:
            close_line()
        opened.pop(to)
        if not opened.stack[-1][1]:
            take(lost, MARKED)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            (lost if opened.stack[-1][1] else text).append(html[at:stop])
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name, closing, within = m["name"].lower(), bool(m["end"]), m["in"] or ""
        if closing:
            k = opened.last(name)
            if k:
                pop(k)
            elif name in _BLOCK:
                close_line()
            continue
        if name == "br":
            (lost if opened.stack[-1][1] else text).append(" ")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        k = max(map(opened.last, _AUTO.get(name, ())), default=0)
        if k and k >= opened.stops[-1]:
            pop(k)
        if name in _BLOCK:
            k = opened.last("p")
            if k and name not in ("p", "td", "th", "option") and opened.blocks[-1] == k:
                pop(k)
            close_line()
        if name in _VOID or within.endswith("/") and name not in _BLOCK:
            continue
        _, dropped, inside = opened.stack[-1]
        if name in ("article", "main") and dropped == 1 and not inside:
            dropped = 0  # names of a wrapper, such as with-sidebar
        own = max(dropped, _dropped(name, _attributes(within), bool(opened.last("article"))))
        opened.push(name, own, inside or name in ("article", "main"))
    close_line()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    in_a, in_b = set(a[lo : len(a) - hi]), set(b[lo : len(b) - hi])
    both = [k for k in range(lo, len(a) - hi) if a[k] in in_b]
    _common([a[k] for k in both], [x for x in b[lo : len(b) - hi] if x in in_a], both, found)
    return found


#: Bits that the rows of an alignment may have; longer pages are split.
ROW_BITS = 1 << 27


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """After each line of ``a`` (or only the last): a zero at each line of ``b`` that makes the common subsequence longer."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(a: list, b: list) -> np.ndarray:
    """The longest common subsequence of ``a`` and the first j lines of ``b``, by j."""
    v = _rows(a, b, keep=False)[0]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(a: list, b: list, at: list[int], found: set[int]) -> None:
    """Adds the places ``at`` of lines of ``a`` in a longest common subsequence; memory is bounded by ROW_BITS."""
    if not a or not b:
        return
    if len(a) * len(b) > ROW_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        _common(a[:half], b[:cut], at[:half], found)
        _common(a[half:], b[cut:], at[half:], found)
        return
    rows = _rows(a, b, keep=True)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(at[i - 1])
            i, j = i - 1, j - 1
        # Zeros among the first j bits of row i: the length for the first i and j lines.
        elif (~rows[i - 1] & ((1 << j) - 1)).bit_count() >= (~rows[i] & ((1 << (j - 1)) - 1)).bit_count():
            i -= 1
        else:
            j -= 1


def neighbours(pages: DataFrame) -> DataFrame:
    """key and other, the page before (of a host's first page: behind) in the order of the host's paths.

    Ranges of the order over all hosts are numbered apart, so a host with many pages lies in many ranges. What stands
    at the ends of a host's part of a range comes from a table of a row for each of these parts.
    """
    order = ["host", "path", "url", "page_id", "key"]
    keys = written(pages.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "page-order")
    rank = F.struct("path", "url", "page_id", "key")
    ends = keys.groupBy("host", "range").agg(F.min_by("key", rank).alias("first"), F.max_by("key", rank).alias("last"))
    along = W.partitionBy("host").orderBy("range")
    ends = ends.select("host", "range", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("behind"))
    within = W.partitionBy("host", "range").orderBy("path", "url", "page_id", "key")
    near = keys.withColumn("lag", F.lag("key").over(within)).withColumn("lead", F.lead("key").over(within)).join(ends, ["host", "range"])
    return near.select("key", F.coalesce("lag", "before", "lead", "behind").alias("other"))


def differences(parsed: DataFrame) -> DataFrame:
    """key and shared, whether each line is also on the nearest page, of pages that have a neighbour; a row for all copies."""
    first = F.min(F.struct("path", "url", "page_id")).alias("first")
    firsts = parsed.where(F.size("hashes") > 0).groupBy("key").agg(F.first("host").alias("host"), first, F.first("hashes").alias("hashes"), F.first("outside").alias("outside"))
    firsts = written(firsts.select("key", "host", "first.*", "hashes", "outside"), "page-firsts", "zstd")
    near = neighbours(firsts).where("other IS NOT NULL")
    pairs = firsts.where("outside").select("key", "hashes").join(near, "key").join(firsts.select(F.col("key").alias("other"), F.col("hashes").alias("others")), "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for a, b in zip(batch.column("hashes").to_pylist(), batch.column("others").to_pylist(), strict=True):
                flags = np.zeros(len(a), bool)
                flags[list(shared_lines(a, b))] = True
                shared.append(flags)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared, pa.list_(pa.bool_()))], names=["key", "shared"])

    return pairs.select("key", "hashes", "others").mapInArrow(align, "key binary, shared array<boolean>")


def main_text(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", marks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, shared_lines, marked_lines of each page; without ``marks`` differencing alone decides outside articles."""
    bare = F.regexp_replace(F.coalesce(df[url].cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    rows = df.select(df[page].alias("page_id"), df[url].cast("string").alias("url"), F.lower(F.regexp_extract(bare, "^[^/]*", 0)).alias("host"), F.regexp_extract(bare, "/.*$", 0).alias("path"), df[html].cast("string").alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    kinds = {c: to_arrow_type(rows.schema[c].dataType) for c in ("page_id", "url", "host", "path")}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]], list[list[int]], list[bytes]]]:
        for piece in pieces(batches, "html"):
            lines, said, keys = [], [], []
            for page, host in zip(piece.column("html").to_pylist(), piece.column("host").to_pylist(), strict=True):
                got = lines_of(page or "")
                lines.append([line for line, _ in got])
                said.append([k if marks or k != MARKED else UNCLEAR for _, k in got])
                told = "".join(map(str, said[-1]))
                keys.append(hashlib.blake2b("\n".join([host or "", told, *lines[-1]]).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield piece, lines, said, keys

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, lines, said, keys in parsed(batches):
            hashes = [[int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in page] for page in lines]
            outside = [any(page) for page in said]
            columns = [piece.column(c).cast(k) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(outside, pa.bool_())], names=[*kinds, "key", "hashes", "outside"])

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, lines, said, keys in parsed(batches):
            columns = [piece.column(c).cast(kinds[c]) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.string())), pa.array(said, pa.list_(pa.int8()))], names=["page_id", "url", "key", "lines", "said"])

    signs = written(rows.mapInArrow(narrow, f"page_id {id_type}, url string, host string, path string, key binary, hashes array<bigint>, outside boolean"), "page-signs", "zstd")
    told = written(differences(signs), "page-shared", "zstd")
    found = rows.mapInArrow(wide, f"page_id {id_type}, url string, key binary, lines array<string>, said array<tinyint>").join(bounded(told, F.size("shared") + 32), "key", "left")
    shared = lambda k: F.coalesce(F.get("shared", k), F.lit(False))
    own = F.filter("lines", lambda _, k: (F.get("said", k) == SURE) | ((F.get("said", k) == UNCLEAR) & ~shared(k)))
    text = F.array_join(own, "\n")
    gone = F.size(F.filter("said", lambda x, k: (x != SURE) & shared(k))).cast("bigint")
    marked = F.size(F.filter("said", lambda x, k: (x == MARKED) & ~shared(k))).cast("bigint")
    return found.select("page_id", "url", text.alias("text"), gone.alias("shared_lines"), marked.alias("marked_lines")).withColumn("n_chars", F.char_length("text").cast("bigint"))
