import duckdb
import pytest

from shuffleframe.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r[c] for c in names) for r in frame.collect()), key=key) == sorted(want.fetchall(), key=key)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    assert {c: kinds[k] for c, k in frame.dtypes} == {c[0]: str(c[1]).upper().replace("STRING", "VARCHAR").replace("NUMBER", "BIGINT").replace("BOOL", "BOOLEAN").replace("BOOLEANEAN", "BOOLEAN") for c in want.description}
