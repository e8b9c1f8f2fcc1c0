"""The exchange store, index files, metrics, the measuring command and the stream sink."""

import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shuffleframe import perf, storage
from shuffleframe.functions.manifest import encode_index
from shuffleframe.metrics import stage_metrics
from shuffleframe.plans.spec import ExchangeSpec
from shuffleframe.sources import indexed
from shuffleframe.sources.store import CorruptExchange, ExchangeStore, Listener, MissingExchange
from shuffleframe.streaming.sink import into_store

SPEC = ExchangeSpec(("k",), 3, order_by=("k",))


@pytest.fixture
def store(spark, tmp_path):
    with ExchangeStore(spark, f"file://{tmp_path}", "app") as s:
        yield s


def rows(spark, lengths, first=0):
    """So many rows with key 0, 1, ..."""
    return spark.createDataFrame([(k, first + i) for k, n in enumerate(lengths) for i in range(n)], "k int, v int")


def lengths(store, i=1):
    got = store.validate(i)
    return got and [r.n_rows for r in got.orderBy("reduce_id").collect()]


def test_write_read_and_ranges(spark, store):
    store.put(rows(spark, [10, 0, 20]), 1, SPEC)
    assert lengths(store) == [10, 0, 20]
    assert sorted((r.k, r.v) for r in store.read(1).collect()) == sorted(tuple(r) for r in rows(spark, [10, 0, 20]).collect())
    assert {r.reduce_id for r in store.read(1, 1, 3).collect()} == {2}
    assert store.read(1, 1, 2).count() == 0
    plan = store.read(1, 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reduce_id" in plan
    with pytest.raises(MissingExchange):
        store.read(7)
    assert store.validate(7) is None


def test_nothing_counts_before_the_commit(spark, store):
    attempt = store.write(rows(spark, [1, 2, 3]), 1, SPEC)
    assert store.counts() == {"committed": 0, "temporary": 1}
    with pytest.raises(MissingExchange):
        store.read(1)
    assert store.commit(attempt) and store.commit(attempt)
    assert store.counts() == {"committed": 1, "temporary": 0}
    with pytest.raises(ValueError):
        store.recall(attempt)
    other = store.write(rows(spark, [1]), 1, SPEC)
    store.recall(other)
    store.recall(other)
    assert store.counts() == {"committed": 1, "temporary": 0}


def spoil(attempt):
    path = glob.glob(f"{attempt.path.removeprefix('file://')}/data/reduce_id=*/*.parquet")[0]
    os.remove(path)
    return path


def test_commit_again(spark, store):
    store.put(rows(spark, [10, 0, 20]), 1, SPEC)
    store.put(rows(spark, [10, 6, 9]), 1, SPEC)
    assert lengths(store) == [10, 6, 9]
    bad = store.write(rows(spark, [3, 3, 3]), 1, SPEC)
    spoil(bad)
    assert not store.commit(bad)
    assert lengths(store) == [10, 6, 9] and store.counts() == {"committed": 1, "temporary": 0}
    store.put(rows(spark, []), 1, SPEC)
    assert store.validate(1) is None and store.read(1).count() == 0
    first = store.write(rows(spark, [3]), 2, SPEC)
    spoil(first)
    with pytest.raises(CorruptExchange):
        store.commit(first)


def test_corrupt_data(spark, store):
    attempt = store.put(rows(spark, [5, 5, 5]), 1, SPEC)
    spoilt = spoil(attempt)
    with pytest.raises(CorruptExchange):
        store.read(1)
    with pytest.raises(CorruptExchange):
        store.validate(1)
    gone = int(spoilt.partition("reduce_id=")[2].partition("/")[0])
    assert store.read(1, gone + 1).count() == 5 * (2 - gone)  # other partitions can be read
    assert store.skipped(1).select("reduce_id").distinct().count() == 1
    assert store.read(1, strict=False).count() == 10


def test_checksum_dump_and_drops(spark, store):
    df = rows(spark, [110, 230, 17])
    store.put(df.repartition(4), 1, SPEC, map_id=F.col("v") % 2)
    store.put(df.orderBy(F.rand(1)), 2, SPEC)
    assert sorted(map(tuple, store.checksum(1).collect())) == sorted(map(tuple, store.checksum(2).collect()))
    assert spark.read.parquet(store.dump(1, 1)).count() == spark.read.parquet(store.dump(1, 1)).count() == 230
    store.drop_map(1, 0)
    store.drop_map(1, 0)
    assert {r.v % 2 for r in store.read(1).collect()} == {1} and lengths(store) == [55, 115, 8]
    assert {r.v % 2 for r in store.read(2, map_ids=[0]).collect()} <= {0, 1}
    store.drop(1)
    store.drop(1)
    assert store.counts() == {"committed": 1, "temporary": 0}


def test_map_layout(spark, store):
    df = rows(spark, [110, 230, 17]).repartition(4)
    attempt = store.put(df, 1, SPEC, layout="map")
    store.put(df, 2, SPEC)
    assert lengths(store) == [110, 230, 17] and store.read(1, 1, 3).count() == 247
    assert sorted(map(tuple, store.checksum(1).collect())) == sorted(map(tuple, store.checksum(2).collect()))
    plan = store.read(1, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(reduce_id), GreaterThanOrEqual(reduce_id,1)" in plan
    written = store.write(df, 3, SPEC, layout="map")
    assert store.commit(written)
    os.remove(glob.glob(f"{attempt.path.removeprefix('file://')}/data/*.parquet")[0])
    with pytest.raises(CorruptExchange):
        store.read(1, 0, 1)
    with pytest.raises(ValueError):
        store.write(df, 4, ExchangeSpec(("k",), 3, "range"), layout="map")


@pytest.mark.parametrize("backend", ["fs", "arrow"])
@pytest.mark.parametrize("codec", [None, "zstd"])
def test_backends_and_codecs(spark, tmp_path, backend, codec):
    with ExchangeStore(spark, f"file://{tmp_path}", "app", backend, compression=codec) as s:
        attempt = s.put(rows(spark, [3, 0, 4]), 1, SPEC)
        assert lengths(s) == [3, 0, 4] and s.read(1).columns == ["k", "v", "map_id", "reduce_id"]
        assert codec is None or glob.glob(f"{tmp_path}/app/**/*.{codec}.parquet", recursive=True)
        files = s._files
        files.replace(f"{s.root}/a/b", "0123456789")
        assert (files.read_range(f"{s.root}/a/b", 3, 4), files.read_range(f"{s.root}/a/b", 8, 9), files.read_range(f"{s.root}/a/b", 99)) == (b"3456", b"89", b"")
        assert files.summary(f"{s.root}/a") == (1, 10) and files.summary(f"{s.root}/none") == (0, 0) and files.read(f"{s.root}/none") is None
        files.copy(f"{s.root}/a", f"{s.root}/c")
        assert files.list(f"{s.root}/c") == ["b"]
        with pytest.raises(FileNotFoundError):
            files.read_range(f"{s.root}/none")
        path = glob.glob(f"{attempt.path.removeprefix('file://')}/data/reduce_id=2/*.parquet")[0]
        with open(path, "wb") as f:
            f.write(b"garbage")
        with pytest.raises(CorruptExchange) as caught:
            s.read_with(1, lambda df: df.count(), 1)
        dumped = f"{s.root}/app/dump/shuffle_1_2"
        assert caught.value.__notes__ == [f"dumped partition 2 to {dumped}"] and files.summary(dumped) == (1, 7)
        assert s.read_with(1, lambda df: df.count(), 0, 2) == 3
        with pytest.raises(ZeroDivisionError) as caught:
            s.read_with(1, lambda df: 1 // 0, 0, 2)
        assert not getattr(caught.value, "__notes__", [])


def test_own_backend(spark, tmp_path):
    made = []

    class Counting(storage.Files):
        def __init__(self, spark, root):
            super().__init__(spark, root)
            made.append(root)

    storage.register_backend("counting", Counting)
    try:
        with pytest.raises(ValueError):
            storage.register_backend("counting", Counting)
        spark.conf.set("shuffleframe.store.backend", "counting")
        spark.conf.set("shuffleframe.store.root", f"file://{tmp_path}")
        spark.conf.set("shuffleframe.store.compression", "gzip")
        with ExchangeStore.configured(spark, app_id="own") as s:
            s.put(rows(spark, [1, 2]), 1, SPEC)
            assert lengths(s) == [1, 2, 0] and made == [f"file://{tmp_path}"] and s.compression == "gzip" and s.clear_on_close
    finally:
        for k in ("backend", "root", "compression"):
            spark.conf.unset(f"shuffleframe.store.{k}")
        del storage.BACKENDS["counting"]


def test_readers_see_commits_of_others(spark, tmp_path):
    one, two = (ExchangeStore(spark, f"file://{tmp_path}", "app", clear_on_close=False) for _ in range(2))
    one.put(rows(spark, [1]), 1, SPEC)
    held = two.read(1)
    one.put(rows(spark, [2]), 1, SPEC)
    assert held.count() == 1 and two.read(1).count() == 1  # what was read stays for a while
    one.put(rows(spark, [3]), 1, SPEC)
    assert two.read(1).count() == 3
    assert two.counts() == {"committed": 1, "temporary": 0}


def test_damage_outside_the_range(spark, store):
    attempt = store.put(rows(spark, [5, 5, 5]), 1, SPEC)
    for path in glob.glob(f"{attempt.path.removeprefix('file://')}/data/reduce_id=1/*.parquet"):
        os.remove(path)
    assert store.skipped(1, 0, 1).count() == 0 and store.skipped(1).count() > 0
    assert store.read(1, 0, 1, strict=False).count() == store.read(1, 2, 3).count() == 5
    assert store.read(1, strict=False).count() == 10


def test_written_maps(spark, tmp_path):
    made = spark.createDataFrame([(m, r, bytes([65 + r]) * (m * r)) for m in range(4) for r in (0, 2, 3)], "map_id int, reduce_id int, content binary")
    for _ in range(2):
        assert sorted(map(tuple, indexed.write_maps(made, f"file://{tmp_path}", 5, 4).collect())) == [(m, 5 * m) for m in range(4)]
    got = {(r.map_id, r.reduce_id): (bytes(r.content), r.valid) for r in indexed.read_partitions(spark, f"file://{tmp_path}").collect()}
    assert got == {(m, r): (bytes([65 + r]) * (m * r), True) for m in range(1, 4) for r in (2, 3)}


def test_unset_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="share"):
        storage.shared_root(Cluster)


def test_failing_input_leaves_nothing(spark, store):
    bad = spark.range(1200).selectExpr("cast(id as int) k", "if(id = 1199, raise_error('broken row'), id) v")
    with pytest.raises(Exception, match="broken row"):
        store.write(bad, 1, SPEC)
    assert store.counts() == {"committed": 0, "temporary": 0}


def test_pointer_is_remembered_until_invalidated(spark, tmp_path):
    store = ExchangeStore(spark, f"file://{tmp_path}", "app", cache_size=2)
    for i in (1, 2, 3):
        store.put(rows(spark, [i]), i, SPEC)
        store.read(i)
    assert list(store._pointers) == [2, 3]
    os.remove(f"{tmp_path}/app/exchange/shuffle_id=3/CURRENT")
    assert store.read(3).count() == 3
    store.invalidate(3)
    with pytest.raises(MissingExchange):
        store.read(3)
    store.invalidate()
    assert not store._pointers


def test_listeners_and_cleanup(spark, tmp_path):
    said = []
    with ExchangeStore(spark, f"file://{tmp_path}", "app", listeners=(Listener(lambda a: said.append(("start", a)), lambda a: said.append(("end", a))),)) as store:
        store.put(rows(spark, [1]), 1, ExchangeSpec(("k",), 4, "range"))
        store.put(rows(spark, [9]), 2, ExchangeSpec((), 4, "round_robin"))
    assert said == [("start", "app"), ("end", "app")] and not os.path.exists(f"{tmp_path}/app")
    with pytest.raises(ValueError):
        ExchangeStore(spark, f"file://{tmp_path}", backend="none")
    with ExchangeStore(spark, f"file://{tmp_path}", "kept", clear_on_close=False) as store:
        store.put(rows(spark, [2]), 1, SPEC)
    assert ExchangeStore(spark, f"file://{tmp_path}", "kept").read(1).count() == 2


def test_index_files(spark, tmp_path):
    data = {m: random.Random(m).randbytes(sum(x)) for m, x in enumerate(([110, 230, 17], [0, 9]))}
    for m, x in enumerate(([110, 230, 17], [0, 9])):
        (tmp_path / f"shuffle_1_{m}_0.data").write_bytes(data[m])
        (tmp_path / f"shuffle_1_{m}_0.index").write_bytes(encode_index(x))
    (tmp_path / "shuffle_1_2_0.data").write_bytes(b"abc")
    (tmp_path / "shuffle_1_2_0.index").write_bytes(encode_index([1, 1]))
    (tmp_path / "shuffle_2_0_3.data").write_bytes(b"hash layout")
    (tmp_path / "shuffle_1_3_0.data").write_bytes(b"")
    (tmp_path / "shuffle_1_3_0.index").write_bytes(b"")
    got = {(r.shuffle_id, r.map_id, r.reduce_id): r for r in indexed.read_partitions(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 0, 3)}
    assert bytes(got[1, 0, 1].content) == data[0][110:340] and got[1, 0, 1].md5 == hashlib.md5(data[0][110:340]).hexdigest().upper()
    assert {k[1] for k, r in got.items() if not r.valid} == {2}
    assert indexed.read_partitions(spark, f"file://{tmp_path}", 1, 2, content=False).count() == 3
    assert [r.offset for r in indexed.read_index(spark, f"file://{tmp_path}").where("map_id = 0").orderBy("i").collect()] == [0, 110, 340, 357]


def test_metrics(spark):
    with stage_metrics(spark) as m:
        spark.range(1000).repartition(5).groupBy((F.col("id") % 3).alias("k")).count().collect()
    assert m["stages"] >= 2 and m["shuffle_write_records"] >= 1000 and m["shuffle_read_bytes"] > 0
    with stage_metrics(spark) as m:
        pass
    assert m["stages"] == 0 and m["shuffle_write_bytes"] == 0


def test_measuring_command(spark, tmp_path, capsys):
    d = perf.PerfOptions()
    assert (d.shuffle_id, d.tasks, d.mappers, d.reducers, d.blocks, d.block_size) == (1, 5, 10, 10, 1024, 262144)
    with pytest.raises(SystemExit):
        perf.parse(["-m", "many"])
    args = ["-b", "1024", "-d", "64", "-m", "4", "-r", "5", "-t", "2", "--root", f"file://{tmp_path}"]
    first = perf.execute(spark, perf.parse([*args, "-o"]))
    assert first["blocks_read"] == 20 and first["bytes_written"] == first["bytes_read"] == "256.00K"
    with pytest.raises(FileExistsError):
        perf.execute(spark, perf.parse(args))
    assert "write_s" not in perf.execute(spark, perf.parse([*args, "-ro"]))
    assert json.dumps(first)


def test_stream_into_store(spark, store, tmp_path):
    source = f"{tmp_path}/in"
    rows(spark, [4, 5, 6]).write.parquet(source)
    stream = spark.readStream.schema("k int, v int").parquet(source)
    for _ in range(2):
        q = into_store(stream, store, SPEC).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    assert lengths(store, 0) == [4, 5, 6] and store.counts() == {"committed": 1, "temporary": 0}
