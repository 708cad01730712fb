import pytest
import json

from pyspark.sql import functions as F

from lodestar.operators import quality
from lodestar.session import ship
from lodestar.sources import readers, writers, xlsx
from lodestar.specs import Check, SourceSpec
from lodestar.streaming import incremental


def test_csv_partitions(spark, tmp_path):
    for day, rows in (("2024-01-01", "1;old\n"), ("2024-02-01", "1;Jos\xe9\n2;\n")):
        folder = tmp_path / f"ingestion_date={day}"
        folder.mkdir()
        (folder / "part.csv").write_bytes(("id;name\n" + rows).encode("latin-1"))
    spec = SourceSpec("s", "people", "csv", {"sep": ";", "encoding": "ISO-8859-1"}, ("id", "name"))
    assert [tuple(r) for r in readers.read(spark, spec, str(tmp_path)).orderBy("id").collect()] == [("1", "José"), ("2", None)]
    assert [r.name for r in readers.read(spark, spec, str(tmp_path), "first").collect()] == ["old"]


def test_json_in_two_grains(spark, tmp_path):
    doc = {"_meta": {}, "records": [{"id": "r1", "org": {"country": "BR"}, "dates": {"open": "2024-01-01"}, "people": [{"n": "a"}, {"n": "b"}]}, {"id": "r2", "org": {"country": "AR"}, "dates": {"open": None}, "people": []}]}
    path = tmp_path / "x.json"
    path.write_text(json.dumps(doc))
    parents, children = readers.split_nested(readers.read(spark, SourceSpec("s", "d", "json"), str(path)), "records", {"org": "org_", "dates": ""}, "people", "id")
    assert sorted(tuple(r) for r in parents.select("id", "org_country", "open").collect()) == [("r1", "BR", "2024-01-01"), ("r2", "AR", None)]
    assert sorted(tuple(r) for r in children.collect()) == [("r1", "a"), ("r1", "b")]


def test_xlsx(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_sheet([["COD", "NAME"], ["1", "Ann & Bob"], ["2", None]]))
    got = readers.read(spark, SourceSpec("s", "d", "xlsx"), str(tmp_path)).orderBy("COD").collect()
    assert [tuple(r) for r in got] == [("1", "Ann & Bob"), ("2", None)]


def test_xlsx_in_parts(spark, tmp_path, monkeypatch):
    """Every way to cut sheets into pieces and parts gives the same rows; parts of several files of different sizes."""
    rows = [["A", "B"], *[[str(k), None if k % 7 == 0 else f"t<{k}> é"] for k in range(300)], [], ["x"]]
    data = xlsx.write_sheet(rows)
    whole = list(xlsx.sheet_rows(data))
    assert whole[0] == ["A", "B"] and whole[5] == ["4", "t<4> é"] and whole[-2:] == [[], ["x"]] and len(whole) == 303
    for block in (700, 2000, 1 << 20):
        monkeypatch.setattr(xlsx, "BLOCK", block)
        for parts in (1, 2, 7, 50):
            assert [r for p in range(parts) for r in xlsx.sheet_rows(data, p, parts)] == whole
    assert list(xlsx.sheet_rows(xlsx.write_sheet([]))) == []


def shared_workbook(rows):
    """Numbers as values, texts as shared strings, cells by reference, a namespace beside the sheet's own."""
    import io
    import zipfile

    texts = sorted({v for r in rows for v in r if isinstance(v, str)})
    cell = lambda k, j, v: f'<c r="{chr(65 + j)}{k + 1}"><v>{v}</v></c>' if not isinstance(v, str) else f'<c r="{chr(65 + j)}{k + 1}" t="s"><v>{texts.index(v)}</v></c>'
    lines = "".join(f'<row r="{k + 1}" x:d="0.2"' + (">" + "".join(cell(k, j, v) for j, v in enumerate(r) if v is not None) + "</row>" if r else "/>") for k, r in enumerate(rows))
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{ns}" xmlns:x="urn:x"><dimension ref="A1"/><sheetData>{lines}</sheetData><pageMargins left="0"/></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in texts) + "</sst>")
    return out.getvalue()


def test_xlsx_of_shared_strings(spark, tmp_path):
    ship(spark)
    rows = [["K", "N"], *[[f"key{k % 5}", k] for k in range(50)], [], [None, 7]]
    (tmp_path / "a.xlsx").write_bytes(shared_workbook(rows))
    (tmp_path / "b.xlsx").write_bytes(shared_workbook([["K", "N"], ["only", 1]]))
    got = sorted((r.K or "", r.N or "") for r in xlsx.read_xlsx(spark, str(tmp_path)).collect())
    assert got == sorted([(f"key{k % 5}", str(k)) for k in range(50)] + [("", ""), ("", "7"), ("only", "1")])


def test_a_large_workbook_in_bounded_memory():
    """300,000 rows (24 MB of XML, several parts' worth of pieces), in a process of its own; memory does not follow the rows."""
    import subprocess
    import sys

    code = """
import io, resource, zipfile
from lodestar.sources import xlsx
out = io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
    f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
    for k in range(300):
        f.write(b"".join(b"<row><c><v>%d</v></c><c><v>1.5</v></c></row>" % (k * 1000 + j) for j in range(1000)))
    f.write(b"</sheetData></worksheet>")
data = out.getvalue()
assert sum(1 for _ in xlsx.sheet_rows(data)) == 300_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0], timeout=300)
    assert int(got.stdout) < 300


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2023-05-01"), (2, "2024-05-01")], "a int, d string").withColumn("d", F.col("d").cast("date"))
    writers.write_by_year(df, f"{tmp_path}/y", "d")
    assert spark.read.parquet(f"{tmp_path}/y").where("year = 2024").count() == 1
    writers.append(df, f"{tmp_path}/h")
    writers.append(df, f"{tmp_path}/h")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4
    told = writers.manifest({"t": df}, seed=1)
    assert told["seed"] == 1 and told["tables"]["t"]["rows"] == 2
    writers.write_nested(df.select("a"), df.select("a", F.col("d").cast("string").alias("d")), "a", "days", f"{tmp_path}/n")
    assert spark.read.json(f"{tmp_path}/n").orderBy("a").first()["days"][0]["d"] == "2023-05-01"


def test_row_ids(spark):
    df = spark.createDataFrame([("10",), ("9",), ("2",)], "n string")
    assert [r._row_id for r in readers.with_row_id(df, "s", "d", "n").orderBy(F.col("n").cast("int")).collect()] == ["s|d|1", "s|d|2", "s|d|3"]


def test_views_of_their_own(spark):
    other = spark.newSession()
    readers.temp_views({"A.b": spark.range(3)}, "L3", other)
    assert other.table("l3__a__b").count() == 3
    assert "l3__a__b" not in [t.name for t in spark.catalog.listTables()]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "_row_id int, v string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    checks = [Check("v", "t", "not_null", "v", "BLOCKER")]
    stream = incremental.landed(spark, f"{tmp_path}/in", df.schema, files=1)
    incremental.checked(stream, "t", checks, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    good, _ = quality.quarantined(df, checks)
    assert sorted(r._row_id for r in spark.read.parquet(f"{tmp_path}/out/approved").collect()) == sorted(r._row_id for r in good.collect())


def test_registry_and_layers(spark, tmp_path):
    from lodestar.sources import registry
    from lodestar.specs import SourceSpec

    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;\n")
    spark.createDataFrame([(1, "p")], "k int, w string").write.parquet(f"{tmp_path}/layer/b")
    spark.createDataFrame([(2,)], "k int").write.parquet(f"{tmp_path}/more")
    csv = SourceSpec(system="A", dataset="a", format="csv", options={"sep": ";"})
    got = registry.ingested(spark, [(csv, f"{tmp_path}/a.csv"), (SourceSpec(system="B", dataset="b", format="parquet"), f"{tmp_path}/layer/b")], split={"B.b": lambda df: {"B.keys": df.select("k"), "B.words": df.select("w")}})
    assert {n: sorted(map(tuple, df.collect()), key=str) for n, df in got.items()} == {"A.a": [("1", "x"), ("2", None)], "B.keys": [("1",)], "B.words": [("p",)]}
    with pytest.raises(ValueError):
        registry.ingested(spark, [(csv, f"{tmp_path}/a.csv")] * 2)
    assert registry.layer(spark, f"{tmp_path}/layer", ["b", "xref_c"], "conform", ("xref",)).keys() == {"b"}
    with pytest.raises(registry.StepMissing, match="run conform first"):
        registry.layer(spark, f"{tmp_path}/layer", ["c"], "conform")
    assert sorted(map(tuple, registry.truth(spark, f"{tmp_path}/layer/b", f"{tmp_path}/more").collect()), key=str) == [("1", "p"), ("2", None)]
