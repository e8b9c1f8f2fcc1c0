"""Partitioning, aggregation, sorting: small cases with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shuffleframe.functions import manifest
from shuffleframe.operators import aggregate, partition, runs, sorting
from shuffleframe.plans.options import OPTIONS, option
from shuffleframe.plans.spec import ExchangeSpec, explain_strategy

SMALL = [(1, 2), (1, 3), (5, 3), (2, 5), (5, 1)]


def pairs(spark, rows, kinds="k int, v int"):
    return spark.createDataFrame(rows, kinds)


def by_partition(df):
    out = {}
    for r in sorted(partition.placed(df).collect(), key=lambda r: (r.partition, r.position)):
        out.setdefault(r.partition, []).append(tuple(r)[:-2])
    return out


def test_sum_dealt_and_sorted(spark):
    sums = aggregate.reduce_by_key(pairs(spark, SMALL), ["k"], {"v": F.sum("v")})
    got = by_partition(sorting.partition_sort(sums, ["k"], 3))
    assert got == {1: [(1, 5)], 2: [(2, 5), (5, 4)]}


@pytest.mark.parametrize("agg", [False, True])
@pytest.mark.parametrize("order", [False, True])
def test_few_keys_in_seven_partitions(spark, agg, order):
    df = pairs(spark, [(1, 1), (2, 2), (5, 5)])
    if agg:
        df = aggregate.reduce_by_key(df, ["k"], {"v": F.sum("v")})
    dealt = partition.exchange(df, ExchangeSpec(("k",), 7, order_by=("k",) if order else ()))
    assert by_partition(dealt) == {1: [(1, 1)], 2: [(2, 2)], 5: [(5, 5)]}
    sizes = {r.reduce_id: r.n_rows for r in partition.partition_sizes(dealt, 7).collect()}
    assert sizes == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0}


def test_skewed_key(spark):
    df = pairs(spark, [(1, 1), (5, 5)] + [(2, 2)] * 1000)
    sizes = partition.partition_sizes(partition.exchange(df, ExchangeSpec(("k",), 7)), 7)
    assert {r.reduce_id: r.n_rows for r in sizes.where("n_rows > 0").collect()} == {1: 1, 2: 1000, 5: 1}
    assert partition.skew_report(sizes).first().largest == 1000


@pytest.mark.parametrize("n", [2, 100])
def test_two_rows_a_key(spark, n):
    df = pairs(spark, [(i // 2, i) for i in range(1000)]).repartition(n)
    assert {r.k: r.v for r in aggregate.reduce_by_key(df, ["k"], {"v": F.max("v")}).collect()} == {k: 2 * k + 1 for k in range(500)}
    assert {r.k: r.v for r in aggregate.group_by_key(df, ["k"], "v").collect()} == {k: [2 * k, 2 * k + 1] for k in range(500)}
    both = aggregate.cogroup(df, df, ["k"], "v", "v").collect()
    assert len(both) == 500 and all(r.left_values == r.right_values == [2 * r.k, 2 * r.k + 1] for r in both)
    for up in (True, False):
        rows = [r.k for r in sorting.sort_by_key(df, ["k"], up, n).collect()]
        assert rows == sorted(rows, reverse=not up) and len(rows) == 1000


def test_cogroup_with_keys_of_one_side(spark):
    got = aggregate.cogroup(pairs(spark, [(i, i) for i in range(1, 5)] + [(None, 9)]), pairs(spark, [(i % 2, i) for i in range(1, 5)] + [(None, 8)]), ["k"], "v", "v").collect()
    assert {r.k: (r.left_values, r.right_values) for r in got} == {0: ([], [2, 4]), 1: ([1], [1, 3]), 2: ([2], []), 3: ([3], []), 4: ([4], []), None: ([9], [8])}


#: Words whose hashes are equal on the Java machine.
EQUAL_HASHES = [("Aa", "BB"), ("to", "v1"), ("variants", "gelato"), ("Teheran", "Siblings"), ("AaAa", "BBBB"), ("AaBB", "BBAa")]


def test_keys_of_equal_hash_stay_apart(spark):
    rows = [(str(i), str(i)) for i in range(1, 1001)] + [x for a, b in EQUAL_HASHES for x in ((a, b), (b, a))]
    got = {r.k: r.v for r in aggregate.group_by_key(pairs(spark, rows, "k string, v string"), ["k"], "v").collect()}
    assert got == {k: [v] for k, v in rows}
    keyed = pairs(spark, [(j, j % 2) for j in range(1, 1001)] * 10).withColumn("key", F.struct("k", "v"))
    assert {r.n for r in aggregate.reduce_by_key(keyed, ["key"], {"n": F.count(F.lit(1))}).collect()} == {10}
    fixed = pairs(spark, [(i, 10) for i in range(1, 501)])
    assert [tuple(r) for r in aggregate.reduce_by_key(fixed, ["v"], {"s": F.sum("k")}).collect()] == [(10, 125_250)]


def test_extreme_and_null_keys(spark):
    rows = [(str(i), str(i)) for i in range(1, 1001)] + [(None, "1"), ("1", None), (None, None)]
    got = {r.k: r.v for r in aggregate.group_by_key(pairs(spark, rows, "k string, v string"), ["k"], "v").collect()}
    assert len(got) == 1001 and got[None] == ["1"] and got["1"] == ["1"]
    top = 2**31 - 1
    assert aggregate.reduce_by_key(pairs(spark, [(i, i) for i in range(1, 1001)] + [(top, top)]), ["k"], {"v": F.sum("v")}).where(F.col("k") == top).first().v == top
    ids = partition.with_reduce_id(pairs(spark, [(None, 1), (-1, 1), (8, 1)]), ["k"], 7)
    assert sorted(r.reduce_id for r in ids.collect()) == [0, 1, 6]
    assert partition.with_reduce_id(pairs(spark, [(None, "a")], "k int, v string"), ["v", "k"], 7, "murmur3").first().reduce_id == 0


def test_merge_of_runs(spark):
    lists = [[1, 3, 5, 7], [2, 3], [7], [5]]
    frames = [spark.createDataFrame([(x,) for x in run], "x int") for run in lists]
    assert [r.x for r in sorting.kway_merge(frames, ["x"], 3).collect()] == [1, 2, 3, 3, 5, 5, 7, 7]


def test_combiners_give_the_same_for_any_split(spark):
    df = pairs(spark, [(i // 4, i) for i in range(1000)])
    create, merge, finish = {"s": F.sum("v"), "n": F.count("v")}, {"s": F.sum, "n": F.sum}, {"mean": F.col("s") / F.col("n")}
    got = [{r.k: r.mean for r in aggregate.combine_by_key(df, ["k"], create, merge, finish, parts=p).collect()} for p in (None, F.pmod("v", F.lit(3)), F.lit(0))]
    assert got[0] == got[1] == got[2] == {k: 4 * k + 1.5 for k in range(250)}


def test_range_reads_and_round_robin(spark):
    dealt = partition.exchange(pairs(spark, [(i, i) for i in range(70)]), ExchangeSpec(("k",), 7))
    assert {r.k % 7 for r in partition.read_partitions(dealt, 2, 5).collect()} == {2, 3, 4}
    assert partition.read_partitions(dealt, 5, 5).count() == 0
    assert partition.partition_sizes(partition.exchange(pairs(spark, SMALL * 100), ExchangeSpec((), 5, "round_robin")), 5).where("n_rows = 0").count() == 0
    ranged = partition.exchange(pairs(spark, [(i, i) for i in range(100)]), ExchangeSpec(("k",), 4, "range", ("k",)))
    ends = sorted((min(x), max(x)) for x in by_partition(ranged).values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_row_index_and_batches(spark):
    df = pairs(spark, [(i % 10, i) for i in range(95)])
    got = sorted((r.row_index, r.v) for r in partition.row_index(df, ["v"], 6).collect())
    assert got == [(i, i) for i in range(95)]
    batched = runs.with_batches(df, ["v"], 10)
    assert sorted(r.v for r in runs.limit_batches(batched, 1, 3).collect()) == list(range(10, 30))
    assert runs.limit_batches(batched, 5, 5).count() == runs.limit_batches(batched, 20, 30).count() == runs.limit_batches(batched, -3, 0).count() == 0
    assert partition.row_index(df.limit(0), ["v"], 3).collect() == []


def test_errors_in_the_input_are_raised(spark):
    bad = pairs(spark, SMALL).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken row"):
        aggregate.reduce_by_key(bad, ["k"], {"v": F.sum("v")}).collect()


def test_lengths_and_offsets(spark):
    lengths = spark.createDataFrame([(0, i, x) for i, x in enumerate([10, 0, 20, 12])], "map_id int, reduce_id int, length long")
    placed = {r.reduce_id: (r.start, r.end) for r in manifest.lengths_to_offsets(lengths, ["map_id"], "reduce_id").collect()}
    assert placed == {0: (0, 10), 1: (10, 10), 2: (10, 30), 3: (30, 42)}
    offsets = spark.createDataFrame([(m, i, x) for m, xs in enumerate(([0, 12, 42, 57, 89], [0, 5, 3], [1, 2], [0])) for i, x in enumerate(xs)], "map_id int, i int, offset long")
    got = manifest.offsets_to_lengths(offsets, ["map_id"], "i").where("map_id = 0").orderBy("i").collect()
    assert [r.length for r in got] == [12, 30, 15, 32]
    sizes = spark.createDataFrame([(0, 89), (1, 3), (2, 2), (3, 0), (9, 4)], "map_id int, data_size long")
    assert {r.map_id: r.valid for r in manifest.validate(offsets, sizes, ["map_id"], "i").collect()} == {0: True, 1: False, 2: False, 3: True, 9: False}


@settings(deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=20))
def test_index_codec(lengths):
    data = manifest.encode_index(lengths)
    assert manifest.check_index(data, sum(lengths)) == (lengths if sum(lengths) else None)
    assert manifest.check_index(data, sum(lengths) + 1) is None and manifest.check_index(None, 0) is None


@pytest.mark.parametrize(
    "scale,n,said",
    [(1024, 0, "0.0"), (1024, 1023.96, "1024.0"), (1024, 1024, "1024.0"), (1024, 1025, "1.00K"), (1024, 3 << 19, "1.50M"), (1000, 1000, "1000.0"), (1000, 1024, "1.02K"), (1000, 3 << 19, "1.57M"), (1000, 7.25e15, "7250.00T"), (1024, 1 << 50, "1024.00T")],
)
def test_size_strings(scale, n, said):
    assert manifest.size_string(n, scale) == said
    with pytest.raises(ValueError):
        manifest.size_string(n, 1 + scale)


def test_hot_keys_in_chunks(spark):
    df = pairs(spark, [(1, i) for i in range(1003)] + [(None, i) for i in range(7)] + [(2, 5), (2, None), (3, None)]).repartition(5)
    got = aggregate.group_by_key_in_chunks(df, ["k"], "v", 10).collect()
    assert sorted(x for r in got if r.k == 1 for x in r.v) == list(range(1003)) and max(len(r.v) for r in got) == 10
    assert sorted(r.chunk for r in got if r.k == 1) == list(range(101)) and {r.k for r in got} == {1, 2, None}
    assert [r.v for r in got if r.k is None] == [list(range(7))] and all(r.v == sorted(r.v) for r in got)
    assert aggregate.group_by_key_in_chunks(df.limit(0), ["k"], "v", 10).collect() == []
    with pytest.raises(ValueError, match="one has 1003"):
        aggregate.group_by_key(df, ["k"], "v", limit=1000)
    assert aggregate.group_by_key(df, ["k"], "v", limit=1003).count() == 4


def test_one_exchange_each(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = pairs(spark, SMALL)
    assert plan(sorting.aggregate_sort(df, ["k"], {"v": F.sum("v")}, 7)).count("Exchange") == 1
    early = plan(partition.exchange(df, ExchangeSpec(("k",), 7), 2, 5))
    assert early.count("Exchange") == 1 and early.index("Exchange") < early.index("Filter")
    assert {r.k for r in partition.exchange(df, ExchangeSpec(("k",), 7), 2, 5).collect()} == {2}
    with pytest.raises(ValueError):
        partition.exchange(df, ExchangeSpec(("k",), 7, "range"), 2, 5)


def test_strategies():
    assert [explain_strategy(*a) for a in ((200, False), (201, False), (200, True), (201, False, False), (1 << 25, False))] == ["bypass", "serialized", "base", "base", "base"]
    with pytest.raises(ValueError):
        explain_strategy(5, True, aggregator=False)
    for bad in ((("k",), 5, "hash"), ((), 5, "mod"), (("k",), 0), (("k",), 5, "round_robin")):
        with pytest.raises(ValueError):
            ExchangeSpec(*bad)


def test_options(spark):
    assert OPTIONS["spark.shuffle.sort.bypassMergeThreshold"].default == 200 and OPTIONS["shuffleframe.store.cacheSize"].default == 10
    assert OPTIONS["spark.shuffle.file.buffer"].default == 32768 and OPTIONS["spark.storage.memoryMapThreshold"].default == 2097152
    spark.conf.set("shuffleframe.store.cacheSize", "3")
    assert option(spark, "shuffleframe.store.cacheSize") == 3
    spark.conf.unset("shuffleframe.store.cacheSize")
    assert option(spark, "shuffleframe.store.clearOnClose") is True


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    dealt = plan(sorting.partition_sort(pairs(spark, SMALL), ["k"], 7))
    assert dealt.count("Exchange") == 1 and "Sort [" in dealt
    summed = plan(aggregate.reduce_by_key(pairs(spark, SMALL), ["k"], {"v": F.sum("v")}))
    assert summed.count("Exchange") == 1 and "partial_sum" in summed
