"""Lines that many documents share, found by range-partitioned hashes; documents keep or lose lines by bitmaps, not texts.

A text is split at \\n; a line's key is the line without white space (space, bytes 9 to 13) at both ends and with A-Z in
lower case. Keys travel as 128 bits of SHA-256 with their document and position: they are partitioned by ranges of
(key, document), so that a key of a third of all lines is spread over many tasks, and sorted by document and position
within them. Streaming over that order, each document's first occurrence of a key is told from its repeats; counts of first
occurrences, summed by task and then by key, are the documents that hold it. Lines of keys in at least ``min_docs``
documents go, and what comes back for each document is a run-length compressed bitmap: ``runs``, the stretches of lines to
drop. Texts never leave their rows.

All of it is DataFrame functions. A document is a row; rows with the same id and the same text are one document, counted
once, and each of them is returned. Null ids are told apart by their texts. A null or empty text is one empty line, which
has no characters and so never goes. A text of any length is one row, its runs one array. An empty table gives an empty
one. Columns of the input keep their names: those made here begin with ``line__`` until they are returned, and a returned
column takes the place of a kept one of its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ("line__doc", "line__mark")


def line_key(line: Column) -> Column:
    """The line stripped, A-Z in lower case. lower() does for lines it doesn't change and for ASCII; others go letter by letter."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when((F.lower(bare) == bare) | ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _body(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def _lines_of(body: Column) -> Column:
    return F.split(body, "\n", -1)


def _named(docs: DataFrame, text: str, doc: str) -> list[Column]:
    """What tells documents apart: the id, and a hash of the text for ids that are null or clash."""
    return [docs[doc].alias("line__doc"), F.xxhash64(_body(docs, text)).alias("line__mark")]


def hashed_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """A row for each line whose key has at least ``min_chars`` code points: its document, position and key."""
    lines = docs.select(*_named(docs, text, doc), F.posexplode(_lines_of(_body(docs, text))).alias("line__at", "line__text"))
    keyed = lines.select(*_DOC, "line__at", line_key(F.col("line__text")).alias("line__text")).where(F.char_length("line__text") >= min_chars)
    return keyed.select(*_DOC, "line__at", F.unhex(F.substring(F.sha2("line__text", 256), 1, 32)).alias("line__key"))


def frequent_keys(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """Keys that at least ``min_docs`` documents hold: ``line__docs`` of them, and the first place of all."""
    dealt = lines.repartitionByRange("line__key", *_DOC)
    order = Window.partitionBy("line__key", *_DOC).orderBy("line__at")
    first = dealt.withColumn("line__nth", F.row_number().over(order)).where("line__nth = 1")
    place = F.struct(*_DOC, "line__at")
    return first.groupBy("line__key").agg(F.count(F.lit(1)).alias("line__docs"), F.min(place).alias("line__first")).where(F.col("line__docs") >= min_docs)


def drop_bitmaps(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """For each document that loses lines, ``runs``: array of (start, length) of the lines to drop, in order.

    With ``keep_first`` the first line of each key, by id, text hash and position, stays.
    """
    lines = _store.written(hashed_lines(docs, text, doc, min_chars), "lines")
    keys = _store.written(frequent_keys(lines, min_docs), "line-keys")
    hits = lines.join(_store.bounded(keys, F.lit(64)), "line__key")
    if keep_first:
        hits = hits.where(~F.struct(*_DOC, "line__at").eqNullSafe(F.col("line__first")))
    at = hits.groupBy(*_DOC).agg(F.sort_array(F.collect_set("line__at")).alias("at"))
    starts = F.filter("at", lambda x, i: F.coalesce(F.get(F.col("at"), i - 1) < x - 1, F.lit(True)))
    ends = F.filter("at", lambda x, i: F.coalesce(F.get(F.col("at"), i + 1) > x + 1, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return at.select(*_DOC, runs.alias("line__runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The stretches of lines between the runs."""
    n = F.size(runs)

    def stretch(k: Column) -> Column:
        before = F.get(runs, k - 1)
        begin = F.when(k == 0, F.lit(0)).otherwise(before["start"] + before["length"])
        return F.slice(lines, begin + 1, F.coalesce(F.get(runs, k)["start"], F.size(lines)) - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))


def deduped_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", keep: tuple[str, ...] | None = None, **rule: int | bool) -> DataFrame:
    """Each row with ``kept_text``, ``n_lines`` (before), ``n_dropped`` and ``runs`` (null where nothing goes).

    The bitmaps are broadcast while they are small, and joined by shuffle beyond that.
    """
    found = _store.written(drop_bitmaps(docs, text, doc, **rule), "line-bitmaps")
    found = found.withColumnsRenamed({c: f"{c}_of" for c in _DOC})
    new = ("kept_text", "n_lines", "n_dropped", "runs")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() not in new)
    rows = docs.select(*[docs[c] for c in keep], *_named(docs, text, doc), _body(docs, text).alias("line__body"))
    on = reduce(Column.__and__, [rows[c].eqNullSafe(found[f"{c}_of"]) for c in _DOC])
    joined = rows.join(_store.bounded(found, 32 + 8 * F.size("line__runs")), on, "left")
    lines, runs = _lines_of(F.col("line__body")), F.col("line__runs")
    split = joined.withColumn("line__lines", lines)
    text_kept = F.when(runs.isNull(), F.col("line__body")).otherwise(F.array_join(_kept(F.col("line__lines"), runs), "\n"))
    lost = F.coalesce(F.aggregate(runs, F.lit(0), lambda n, r: n + r["length"]), F.lit(0))
    return split.select(*keep, text_kept.alias("kept_text"), F.size("line__lines").cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"), runs.alias("runs"))


def line_digests(docs: DataFrame, text: str = "text", doc: str = "doc_id", **rule: int | bool) -> DataFrame:
    """Counts and a digest of each document's kept text."""
    got = deduped_lines(docs, text, doc, (doc,), **rule)
    return got.select(doc, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
