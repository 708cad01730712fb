import json
import random

import pytest

from lodestar.sources import documents, readers
from lodestar.specs import SourceSpec

AWKWARD = ['{"', '"}', "\\", '\\"', "[]{}", '"records": [', "é中\n", "", "}" * 9, "plain"]


def document(seed, n):
    rnd = random.Random(seed)

    def text():
        return "".join(rnd.choices(AWKWARD, k=rnd.randint(0, 4)))

    people = lambda: [{"c": rnd.randint(0, 99), "t": text()} for _ in range(rnd.randint(0, 3))]
    records = [{"id": k, "note": text(), "org": {"a": text(), "records": [{"x": 1}]}, "share": k + 0.5, "people": people()} for k in range(n)]
    return {"_meta": {"records": [{"id": -1}], "of": {"id": -2}, "list": [[{"id": -3}]]}, "other": [{"id": -4}], "records": records, "after": [{"id": -5}], "end": "}"}


@pytest.fixture
def ranges(spark):
    yield lambda size: [spark.conf.set(f"spark.sql.files.{k}", size) for k in ("maxPartitionBytes", "openCostInBytes")]
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("size", [13, 64, 777, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_at_any_range_size(spark, tmp_path, ranges, size, indent):
    docs = [document(1, 25), document(2, 0), document(3, 4)]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=k == 0) + "\n" * k)
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "without.json").write_text('{"rows": [{"id": 7}]}')
    ranges(size)
    got = documents.record_texts(spark, str(tmp_path)).orderBy("file", "start", "k").collect()
    assert [json.loads(r.json) for r in got] == [r for d in docs for r in d["records"]]


def test_two_grains_equal_the_plain_reader(spark, tmp_path, ranges):
    (tmp_path / "d.json").write_text(json.dumps(document(4, 30)))
    whole = readers.read(spark, SourceSpec("s", "d", "json"), str(tmp_path))
    want = [sorted(map(tuple, df.collect()), key=repr) for df in readers.split_nested(whole.drop("_meta", "after", "other"), "records", {}, "people", "id")]
    ranges(100)
    rows = readers.read(spark, SourceSpec("s", "d", "json", {"records": "records"}), str(tmp_path))
    got = readers.grains(rows, {}, "people", "id")
    assert [sorted(map(tuple, df.collect()), key=repr) for df in got] == want
    typed = documents.read_records(spark, str(tmp_path), schema="id string, nothing string")
    assert sorted(r.id for r in typed.collect()) == sorted(map(str, range(30))) and typed.where("nothing IS NOT NULL").isEmpty()


def test_no_records(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"records": []}')
    assert documents.read_records(spark, str(tmp_path)).count() == 0


def test_first_file_and_ragged_lines(spark, tmp_path):
    for day, name, text in (("2024-01-02", "a", "x;y\n9;9\n"), ("2024-01-01", "b c", "x;y\n1;2\n3;4;5\n6\n\"7;\n7\";\n"), ("2024-01-01", "d", "x;y\n8;8\n;1\n")):
        (tmp_path / f"ingestion_date={day}").mkdir(exist_ok=True)
        (tmp_path / f"ingestion_date={day}" / f"{name}.csv").write_text(text)
    spec = SourceSpec("s", "d", "csv", {"sep": ";", "multiLine": True})
    assert readers.first_file(spark, spec, str(tmp_path)).endswith("ingestion_date=2024-01-01/b c.csv")
    rows = sorted(map(tuple, readers.read(spark, spec, str(tmp_path), "first_file").collect()))
    assert rows == [("1", "2"), ("3", "4"), ("6", None), ("7;\n7", None)]
    assert {r.file.replace("%20", " "): (r.lines, r.broken, r.unkeyed) for r in readers.broken_lines(spark, spec, str(tmp_path)).collect()} == {"a.csv": (1, 0, 0), "b c.csv": (4, 2, 0), "d.csv": (2, 0, 1)}
    with pytest.raises(FileNotFoundError, match="no .parquet file"):
        readers.first_file(spark, SourceSpec("s", "d", "parquet"), str(tmp_path))
