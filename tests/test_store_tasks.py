"""What one task has of a store's write doesn't grow with a partition's rows."""

import glob
import os
import shutil

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shuffleframe import storage
from shuffleframe.plans.spec import ExchangeSpec
from shuffleframe.sources.store import ExchangeStore


@pytest.fixture
def small_tasks(spark):
    """Sizes that a large table has at Spark's defaults."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "16k")
    yield
    spark.conf.unset(key)


def written(path):
    """The files of each partition that lie below a folder: {folder: [file]}."""
    found = {}
    for x in glob.glob(f"{path.removeprefix('file://')}/**/data/reduce_id=*/*.parquet", recursive=True):
        found.setdefault(os.path.dirname(x), []).append(x)
    return found


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path, small_tasks, adaptive):
    df = spark.range(0, 60000, 1, 6).selectExpr("cast(if(id % 10 < 8, 0, id % 3) as int) k", "id v")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        with ExchangeStore(spark, f"file://{tmp_path}", "app") as store:
            attempt = store.put(df, 1, ExchangeSpec(("k",), 3, order_by=("v",)))
            files = written(attempt.path)
            rows = {p: [pq.ParquetFile(x).read(["v"]).column("v").to_pylist() for x in xs] for p, xs in files.items()}
            large = next(v for p, v in rows.items() if p.endswith("reduce_id=0"))
            assert len(large) > 1 and max(map(len, large)) < 0.6 * sum(map(len, large))
            assert all(x == sorted(x) for v in rows.values() for x in v)
            want = {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
            assert {r.reduce_id: r.n_rows for r in store.validate(1).collect()} == want
            assert sorted(map(tuple, store.read(1).select("reduce_id", "k", "v").collect())) == sorted((r.k, r.k, r.v) for r in df.collect())
            store.put(df.orderBy(F.rand(1)), 2, ExchangeSpec(("k",), 3), layout="map")
            assert sorted(map(tuple, store.checksum(1).collect())) == sorted(map(tuple, store.checksum(2).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", [
    "store_dump_on_error", "store_read_around_damage", "store_dump_partition", "store_drop_map", "store_range_read", "store_roundtrip", "stream_into_store",
])
def test_tasks_of_queries(spark, tmp_path, small_tasks, name):
    for i in range(4):
        os.makedirs(f"{tmp_path}/lineitem.parquet", exist_ok=True)
        shutil.copyfile("/root/testdata/sf0.001/lineitem.parquet", f"{tmp_path}/lineitem.parquet/{i}.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    files = written(next(x for x in reversed(storage._made) if "/store-" in x))
    counts = {p: [pq.ParquetFile(x).metadata.num_rows for x in xs] for p, xs in files.items() if not p.endswith("reduce_id=4")}
    assert len(counts) == 6 and all(max(n) < 0.6 * sum(n) for n in counts.values()), counts
