"""Every query against its SQL on the small tables."""

import os

import duckdb
import pytest

from lodestar.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(oracle.sql(sql).columns) == columns
    assert plain(got) == plain(oracle.sql(f"SELECT {quoted} FROM ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["period", "region", "value", "population", "suppression"]
