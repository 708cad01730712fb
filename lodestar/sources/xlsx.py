"""Spreadsheets' first sheet as text, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Bytes of a sheet's XML that are parsed at once, and that make a part of their own.
BLOCK, PART = 1 << 20, 64 << 20
#: Rows of a batch.
ROWS = 10_000
_END = re.compile(rb"</(?:\w+:)?row>")


def _texts(z: zipfile.ZipFile) -> pa.StringArray:
    """The shared strings, read in a stream."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return pa.array([], pa.string())
    parts, some = [], []
    with z.open("xl/sharedStrings.xml") as stream:
        root = None
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            root = e if root is None else root
            if event == "end" and e.tag == f"{{{_NS['m']}}}si":
                some.append("".join(t.text or "" for t in e.iter(f"{{{_NS['m']}}}t")))
                root.clear()
                if len(some) >= 100_000:
                    parts.append(pa.array(some, pa.string()))
                    some = []
    return pa.concat_arrays([*parts, pa.array(some, pa.string())])


def _sheet(z: zipfile.ZipFile) -> zipfile.ZipInfo:
    return min((i for i in z.infolist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", i.filename)), key=lambda i: i.filename)


def _blocks(stream: IO[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """(place of its first byte, the sheet's opening tag, whole rows) of pieces of about BLOCK bytes."""
    head = stream.read(BLOCK)
    while (data := re.search(rb"<(?:\w+:)?sheetData\b[^>]*>", head)) is None:
        more = stream.read(BLOCK)
        if not more:
            return
        head += more
    if data[0].endswith(b"/>"):
        return
    opening = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", head)[0]
    at, rest = data.end(), head[data.end() :]
    while True:
        more = stream.read(BLOCK)
        rest += more
        if (stop := re.search(rb"</(?:\w+:)?sheetData\s*>", rest)) is not None:
            yield at, opening, rest[: stop.start()]
            return
        ends = [m.end() for m in _END.finditer(rest)]
        if ends:
            yield at, opening, rest[: ends[-1]]
            at, rest = at + ends[-1], rest[ends[-1] :]
        if not more:
            return


def sheet_rows(data: bytes, part: int = 0, parts: int = 1) -> Iterator[list[str | None]]:
    """The first sheet's rows as text; the header is the first of them. An empty sheet has none.

    The sheet is inflated in a stream and parsed piece by piece, so that memory holds a piece and the shared strings. Of
    several parts, each parses the pieces that begin in its share of the sheet's bytes and skips the others unparsed.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info, shared = _sheet(z), None
        lo, hi = info.file_size * part // parts, info.file_size * (part + 1) // parts
        with z.open(info) as stream:
            for at, opening, rows in _blocks(stream):
                if at >= hi:
                    return
                if at < lo:
                    continue
                name = re.match(rb"<((?:\w+:)?worksheet)", opening)[1]
                for row in ElementTree.fromstring(opening + rows + b"</" + name + b">").iterfind("m:row", _NS):
                    cells: dict[int, str | None] = {}
                    for k, c in enumerate(row.findall("m:c", _NS)):
                        value, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                        text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None if value is None else value.text
                        if c.get("t") == "s" and text is not None:
                            shared = _texts(z) if shared is None else shared
                            text = shared[int(text)].as_py()
                        cells[_column(c.get("r")) if c.get("r") else k] = text
                    yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def sheet_parts(data: bytes) -> int:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return max(1, -(-_sheet(z).file_size // PART))


def write_sheet(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet with inline text, for small outputs and tests."""
    from xml.sax.saxutils import escape

    lines = "".join("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in r) + "</row>" for r in rows)
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_NS["m"]}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook, or a folder of workbooks with one header, as text; each file is parsed where Spark reads it.

    A large sheet is parsed in parts of PART bytes of XML, each by a task that reads the file itself; all files are scanned
    once for each part that the largest of them has, and those of fewer parts say nothing to the later ones.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"path": [at], "names": pa.array([next(sheet_rows(data), [])], pa.list_(pa.string())), "parts": pa.array([sheet_parts(data)], pa.int32())})

    about = files.mapInArrow(header, "path string, names array<string>, parts int").agg(F.min(F.struct("path", "names")).alias("first"), F.max("parts").alias("parts")).first()
    names = [n or f"column{k + 1}" for k, n in enumerate(about["first"]["names"] if about["first"] else [])]
    schema = StructType([StructField(n, StringType()) for n in names])

    def reader(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], pa.string()) for k in range(len(names))], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    data = batch.column("content")[k].as_py()
                    parts = sheet_parts(data)
                    rows = sheet_rows(data, part, parts) if part < parts else iter(())
                    if part == 0:
                        next(rows, None)
                    while some := list(islice(rows, ROWS)):
                        yield table(some)

        return run

    return reduce(DataFrame.unionAll, [files.mapInArrow(reader(p), schema) for p in range(about["parts"] or 1)])
