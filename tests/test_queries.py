"""Every query with SQL is held against it, names, types and values."""

import duckdb
import pytest

import __spark_entry__ as entry
from shuffleframe.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = db.execute(catalogue.ORACLES[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert sorted(kinds) == columns
    names = [c[0] for c in want.description]
    order = [names.index(c) for c in columns]
    key = lambda row: tuple((x is None, x) for x in row)
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key) == rows
    for c, kind in frame.dtypes:
        assert TYPES[kind] == kinds[c].upper() or TYPES[kind] in kinds[c].upper(), (c, kind, kinds[c])


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["l_orderkey", "sum_qty"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) == set(catalogue.ORACLES)
