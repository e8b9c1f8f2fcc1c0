"""The toolkit's queries over the test tables, and the SQL that each is held against.

Queries about placement read where rows physically lie (partition and position), not a window that would sort again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import perf
from ..functions import manifest
from ..metrics import stage_metrics
from ..operators import aggregate, partition, runs, sorting
from ..sources import indexed
from ..sources.store import CorruptExchange, ExchangeStore, Listener
from ..storage import materialise, new_folder
from ..streaming.sink import into_store
from .options import OPTIONS, option
from .spec import ExchangeSpec, strategies

#: Partitions of most queries, and the rows of a batch.
N, BATCH = 7, 1000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*columns)


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(*columns)


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _store(spark: SparkSession, **options) -> ExchangeStore:
    """A store that stays, as results are lazy; storage.release() deletes its folder."""
    return ExchangeStore.configured(spark, **({"root": new_folder(spark, "store"), "app_id": "queries", "clear_on_close": False} | options))


def hash_partition_sizes(spark, d):
    dealt = partition.exchange(_items(spark, d, "l_orderkey"), ExchangeSpec(("l_orderkey",), N))
    return _long(partition.partition_sizes(dealt, include_empty=False), "reduce_id", "n_rows")


def partition_sizes_with_empties(spark, d):
    dealt = partition.exchange(_items(spark, d, "l_linenumber"), ExchangeSpec(("l_linenumber",), 11))
    return _long(partition.partition_sizes(dealt, 11), "reduce_id")


def skip_empty_partitions(spark, d):
    dealt = partition.exchange(_items(spark, d, "l_linenumber"), ExchangeSpec(("l_linenumber",), 11))
    return _long(partition.partition_sizes(dealt, 11).where("n_rows > 0"), "reduce_id")


def round_robin_balance(spark, d):
    sizes = partition.partition_sizes(partition.exchange(_items(spark, d, "l_orderkey"), ExchangeSpec((), 8, "round_robin")), 8)
    report = partition.skew_report(sizes)
    return report.select("partitions", "total_rows", (F.col("skew") < 1.1).alias("balanced"))


def partition_range_read(spark, d):
    return partition.exchange(_items(spark, d, "l_orderkey", "l_partkey", "l_quantity"), ExchangeSpec(("l_orderkey",), N), 2, 5)


def reduce_by_key_sum(spark, d):
    return aggregate.reduce_by_key(_items(spark, d, "l_orderkey", "l_quantity"), ["l_orderkey"], {"sum_qty": F.sum("l_quantity")}, order_by=["l_orderkey"])


def reduce_by_key_max(spark, d):
    return aggregate.reduce_by_key(_items(spark, d, "l_orderkey", "l_extendedprice"), ["l_orderkey"], {"max_price": F.max("l_extendedprice")})


def reduce_by_key_count(spark, d):
    return aggregate.reduce_by_key(_items(spark, d, "l_suppkey"), ["l_suppkey"], {"n": F.count(F.lit(1))})


def ordered_aggregate(spark, d):
    """Reduce-side pipeline: exchange, aggregate, sort within partitions, in one exchange; with each key's partition and place."""
    dealt = sorting.aggregate_sort(_items(spark, d, "l_partkey", "l_quantity"), ["l_partkey"], {"sum_qty": F.sum("l_quantity")}, N)
    return _long(partition.placed(dealt), "partition", "position")


def two_phase_aggregate(spark, d):
    partial = _items(spark, d, "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", F.pmod("l_linenumber", F.lit(4)).alias("part")).agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))
    return aggregate.merge_partials(partial, ["l_orderkey"], {"sum_qty": F.sum, "n": F.sum})


def combine_by_key_avg(spark, d):
    items = _items(spark, d, "l_partkey", "l_linenumber", "l_quantity")
    create = {"s": F.sum("l_quantity"), "n": F.count("l_quantity")}
    return aggregate.combine_by_key(items, ["l_partkey"], create, {"s": F.sum, "n": F.sum}, {"avg_qty": F.round(F.col("s") / F.col("n"), 6)}, parts=F.pmod("l_linenumber", F.lit(3)))


def group_by_key_list(spark, d):
    lists = aggregate.group_by_key(_items(spark, d, "l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey", "parts")
    return lists.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def cogroup_orders_lineitem(spark, d):
    both = aggregate.cogroup(_orders(spark, d, F.col("o_orderkey").alias("k"), "o_custkey"), _items(spark, d, F.col("l_orderkey").alias("k"), "l_partkey"), ["k"], "o_custkey", "l_partkey")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return both.select("k", join("left_values"), join("right_values"))


def hash_collision_group(spark, d):
    items = _items(spark, d, "l_partkey").withColumn("key", F.struct(F.pmod("l_partkey", F.lit(2)).alias("h"), F.col("l_partkey").alias("v")))
    return aggregate.reduce_by_key(items, ["key"], {"n": F.count(F.lit(1))}).select("key.h", "key.v", "n")


def null_key_group(spark, d):
    items = _items(spark, d, "l_orderkey", "l_quantity").withColumn("k", F.expr("nullif(pmod(l_orderkey, 5), 0)"))
    return aggregate.reduce_by_key(items, ["k"], {"n": F.count(F.lit(1)), "sum_qty": F.sum("l_quantity")})


def struct_field_sum(spark, d):
    items = _items(spark, d, "l_suppkey", "l_linenumber").withColumn("value", F.struct(F.col("l_linenumber").alias("v"), F.lit(10).alias("h")))
    return aggregate.reduce_by_key(items, ["l_suppkey"], {"sum_v": F.sum("value.v"), "sum_h": F.sum("value.h")})


def sort_within_partition(spark, d):
    dealt = sorting.partition_sort(_orders(spark, d, "o_orderkey", "o_totalprice"), ["o_orderkey"], N, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return _long(partition.placed(dealt).select("o_orderkey", "partition", "position"), "partition", "position")


def range_partition_sort(spark, d):
    return partition.row_index(_orders(spark, d, "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], N)


def descending_sort(spark, d):
    return partition.row_index(_orders(spark, d, "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], N)


def range_partition_disjoint(spark, d):
    """Ranges of a global sort: none overlaps the next, none is out of order inside, no row is lost."""
    dealt = materialise(partition.placed(sorting.sort_by_key(_orders(spark, d, "o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], n=5)))
    ends = dealt.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o_custkey", "o_orderkey")).alias("low"), F.max(F.struct("o_custkey", "o_orderkey")).alias("high"), F.min_by(F.struct("o_custkey", "o_orderkey"), "position").alias("first"), F.max_by(F.struct("o_custkey", "o_orderkey"), "position").alias("last"))
    # a row a partition from here on, five in all
    over = ends.withColumn("overlaps", F.coalesce(F.col("low") <= F.lag("high").over(W.orderBy("partition")), F.lit(False)))
    return over.agg(F.sum("n").alias("total_rows"), F.bool_and(F.expr("low = first and high = last")).alias("in_order"), F.count_if("overlaps").alias("n_overlaps"))


def kway_merge(spark, d):
    orders = _orders(spark, d, "o_orderkey", "o_totalprice")
    merged = sorting.kway_merge([orders.where(F.pmod("o_orderkey", F.lit(4)) == i) for i in range(4)], ["o_totalprice", "o_orderkey"], N)
    return partition.row_index_as_placed(merged)


def hash_order_sort(spark, d):
    """Rows in the order of their key's hash within partitions: none out of order, and the rows of each key together."""
    dealt = materialise(partition.placed(sorting.hash_sort(_orders(spark, d, "o_custkey"), ["o_custkey"], N)).withColumn("h", F.hash("o_custkey")))
    # neighbours in a partition; N partitions
    before = W.partitionBy("partition").orderBy("position")
    steps = dealt.withColumn("fell", F.lag("h").over(before) > F.col("h")).withColumn("begins", ~F.col("o_custkey").eqNullSafe(F.lag("o_custkey").over(before)))
    return steps.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("fell").alias("out_of_order"), F.count_if("begins").alias("runs_of_keys"))


def group_by_key_chunks(spark, d):
    """A hot key's values in chunks of 100 at most: how many chunks and values each key has, and its smallest and largest value."""
    lists = aggregate.group_by_key_in_chunks(_items(spark, d, "l_linenumber", "l_orderkey"), ["l_linenumber"], "l_orderkey", 100, "orders")
    found = lists.groupBy(F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("orders").cast("long")).alias("n_values"), F.max(F.size("orders").cast("long")).alias("largest"), F.min(F.array_min("orders")).alias("low"), F.max(F.array_max("orders")).alias("high"))
    return found


def _map_lengths(spark, d):
    return _items(spark, d, "l_linenumber", "l_orderkey").groupBy(F.col("l_linenumber").cast("long").alias("map_id"), F.pmod("l_orderkey", F.lit(N)).alias("reduce_id")).agg(F.count(F.lit(1)).alias("length"))


def map_status(spark, d):
    return _map_lengths(spark, d)


def lengths_to_offsets(spark, d):
    return manifest.lengths_to_offsets(_map_lengths(spark, d), ["map_id"], "reduce_id").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def _offsets(spark, d):
    placed = lengths_to_offsets(spark, d)
    return placed.select("map_id", F.col("reduce_id").alias("i"), F.col("start").alias("offset")).unionByName(placed.groupBy("map_id").agg((F.max("reduce_id") + 1).alias("i"), F.max("end").alias("offset")))


def offsets_to_lengths(spark, d):
    return manifest.offsets_to_lengths(_offsets(spark, d), ["map_id"], "i").select("map_id", F.col("i").alias("reduce_id"), "length")


def manifest_validate(spark, d):
    """Every second map's data file is a row short."""
    sizes = _items(spark, d, "l_linenumber").groupBy(F.col("l_linenumber").cast("long").alias("map_id")).agg((F.count(F.lit(1)) - F.pmod(F.first("l_linenumber"), F.lit(2))).alias("data_size"))
    return manifest.validate(_offsets(spark, d), sizes, ["map_id"], "i")


def index_file_roundtrip(spark, d):
    """Index files of map outputs with a byte a row, written and read again: each partition's end, also as the file's big-endian word."""
    ends = indexed.read_index(spark, _index_files(spark, d)).where("i > 0")
    return ends.select(F.col("map_id").cast("long").alias("map_id"), (F.col("i") - 1).cast("long").alias("reduce_id"), F.lower(F.lpad(F.hex("offset"), 16, "0")).alias("word"), F.col("offset").alias("end"))


def _index_files(spark, d) -> str:
    folder = new_folder(spark, "maps")
    content = _map_lengths(spark, d).select("map_id", "reduce_id", F.expr("repeat(cast(reduce_id as string), cast(length as int))").alias("content"))
    indexed.write_maps(content, folder, 1, N).collect()  # a row a map
    return folder


def index_partitions(spark, d):
    """The partitions 2 to 4 of the same files: where their bytes lie, and the bytes' MD5."""
    found = indexed.read_partitions(spark, _index_files(spark, d), 2, 5, content=False)
    return _long(found.drop("shuffle_id"), "map_id", "reduce_id")


def partition_checksum(spark, d):
    """Sum and exclusive or of a hash of each partition's rows: combined on the map side, whatever the order."""
    dealt = partition.exchange(_items(spark, d, "l_orderkey", "l_partkey"), ExchangeSpec(("l_orderkey",), N))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return dealt.groupBy(F.spark_partition_id().cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("hash_sum"), F.bit_xor(key).alias("hash_xor"))


def store_roundtrip(spark, d):
    store = _store(spark)
    store.put(_items(spark, d, "l_orderkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N))
    return store.read(1).groupBy(F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


def store_range_read(spark, d):
    store = _store(spark)
    store.put(_items(spark, d, "l_orderkey", "l_partkey"), 1, ExchangeSpec(("l_orderkey",), N))
    return _long(store.read(1, 2, 5).select("reduce_id", "l_orderkey", "l_partkey"), "reduce_id")


def store_lengths(spark, d):
    store = _store(spark)
    store.put(_items(spark, d, "l_linenumber"), 1, ExchangeSpec(("l_linenumber",), 11))
    return _long(store.validate(1), "reduce_id")


def store_recommit(spark, d):
    """Of two commits the later valid one counts."""
    store = _store(spark)
    items = _items(spark, d, "l_orderkey", "l_quantity")
    store.put(items.where("l_quantity <= 10"), 1, ExchangeSpec(("l_orderkey",), N))
    store.put(items.where("l_quantity > 10"), 1, ExchangeSpec(("l_orderkey",), N))
    return store.read(1).groupBy(F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_quantity").alias("min_qty"))


def store_invalid_commit(spark, d):
    """An attempt whose files are gone doesn't count: the commit before it stays."""
    store = _store(spark)
    items = _items(spark, d, "l_orderkey", "l_quantity")
    store.put(items.where("l_quantity <= 10"), 1, ExchangeSpec(("l_orderkey",), N))
    bad = store.write(items.where("l_quantity > 10"), 1, ExchangeSpec(("l_orderkey",), N))
    store._files.delete(f"{bad.path}/data/reduce_id=3")
    taken = store.commit(bad)
    return store.read(1).groupBy(F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("l_quantity").alias("max_qty")).withColumn("taken", F.lit(taken))


def store_skipped_partitions(spark, d):
    """A partition's files are gone: what is left out of a read that isn't strict, by map and partition."""
    store = _store(spark)
    attempt = store.put(_items(spark, d, "l_orderkey", "l_linenumber"), 1, ExchangeSpec(("l_orderkey",), N), map_id=F.col("l_linenumber"))
    store._files.delete(f"{attempt.path}/data/reduce_id=3")
    return _long(store.skipped(1).select("map_id", "reduce_id", "told_rows", F.coalesce("found_rows", F.lit(0)).alias("found_rows")), "map_id", "reduce_id")


def store_read_around_damage(spark, d):
    """A partition's file holds garbage: the rows that a read that isn't strict gives, by partition."""
    store = _store(spark)
    attempt = store.put(_items(spark, d, "l_orderkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N))
    _damage(store, attempt, 4)
    return store.read(1, 2, 6, strict=False).groupBy(F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


def _damage(store: ExchangeStore, attempt, reduce_id: int) -> None:
    """Puts one file of garbage in the place of a partition's files, however many there are."""
    folder = f"{attempt.path}/data/reduce_id={reduce_id}"
    names = store._files.list(folder)
    for name in names[:-1]:
        store._files.delete(f"{folder}/{name}")
    for name in names[-1:]:
        store._files.replace(f"{folder}/{name}", "garbage")


def store_dump_on_error(spark, d):
    """A partition's file holds garbage: a reader that fails leaves that partition's files, as they are, beside the store."""
    store = _store(spark)
    attempt = store.put(_items(spark, d, "l_orderkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N))
    _damage(store, attempt, 4)
    try:
        store.read_with(1, lambda rows: rows.count())
        failed = False
    except CorruptExchange:
        failed = True
    dumps = store._files.list(f"{store.root}/{store.app_id}/dump")
    rows = [(name, failed, store._files.summary(f"{store.root}/{store.app_id}/dump/{name}")[1]) for name in dumps]
    return spark.createDataFrame(rows, "dump string, failed boolean, bytes long")


def store_codecs(spark, d):
    """The same rows by each codec of the data files."""
    found = []
    for codec in ("uncompressed", "snappy", "zstd", "gzip"):
        store = _store(spark, compression=codec)
        store.put(_items(spark, d, "l_orderkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N))
        found.append(store.read(1).groupBy(F.lit(codec).alias("codec"), F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.sum("l_quantity").alias("sum_qty")))
    return reduce(DataFrame.unionByName, found)


def store_backends(spark, d):
    """The same rows through each backend of the store, in the layout map."""
    found = []
    for name in ("fs", "arrow"):
        store = _store(spark, backend=name)
        store.put(_items(spark, d, "l_orderkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N), layout="map")
        found.append(store.read(1, 1, 4).groupBy(F.lit(name).alias("backend"), F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.sum("l_quantity").alias("sum_qty")))
    return reduce(DataFrame.unionByName, found)


def store_second_session(spark, d):
    """Another store on the same folder sees a commit that was made after it had read."""
    one = _store(spark)
    other = _store(spark, root=one.root, pointer_seconds=0.0)
    items = _items(spark, d, "l_orderkey", "l_quantity")
    one.put(items.where("l_quantity <= 10"), 1, ExchangeSpec(("l_orderkey",), N))
    before = other.read(1).agg(F.lit("before").alias("step"), F.count(F.lit(1)).alias("n_rows"))
    one.put(items.where("l_quantity > 10"), 1, ExchangeSpec(("l_orderkey",), N))
    return before.unionByName(other.read(1).agg(F.lit("after").alias("step"), F.count(F.lit(1)).alias("n_rows")))


def store_life(spark, d):
    """Attempts and commits that a store counts as it is written to, dropped from and cleaned up, and what its listeners hear."""
    heard: list[str] = []
    store = _store(spark, clear_on_close=True, listeners=(Listener(lambda a: heard.append(f"start {a}"), lambda a: heard.append(f"end {a}")),))
    items, spec = _items(spark, d, "l_orderkey"), ExchangeSpec(("l_orderkey",), N)
    steps = []
    say = lambda step: steps.append((step, store.counts()["committed"], store.counts()["temporary"], len(heard)))
    attempt = store.write(items, 1, spec)
    say("written")
    store.commit(attempt)
    store.put(items, 2, spec)
    say("committed")
    store.recall(store.write(items, 2, spec))
    say("recalled")
    store.drop(1)
    say("dropped")
    store.close()
    say("closed")
    return spark.createDataFrame(steps, "step string, committed long, temporary long, heard long")


def stream_into_store(spark, d):
    """A stream's batches as exchanges: all rows, by partition."""
    store = _store(spark)
    # a folder of its own: a stream reads folders
    source = new_folder(spark, "stream")
    _items(spark, d, "l_orderkey", "l_quantity").write.parquet(source)
    stream = spark.readStream.schema("l_orderkey long, l_quantity double").parquet(source)
    run = into_store(stream, store, ExchangeSpec(("l_orderkey",), N)).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    batches = [store.read(i) for i in range(store.counts()["committed"])]
    return reduce(DataFrame.unionByName, batches).groupBy(F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


def perf_report(spark, d):
    """What the measuring command writes and reads, at a small size."""
    args = ["-b", "1024", "-d", "64", "-m", "4", "-r", "5", "-o", "--scale", "1000", "--root", new_folder(spark, "perf")]
    report = perf.execute(spark, perf.parse(args))
    return spark.createDataFrame([(report["blocks_read"], report["bytes_written"], report["bytes_read"], report["partition_size"])], "blocks_read long, bytes_written string, bytes_read string, partition_size string")


def exchange_metrics(spark, d):
    """What Spark tells of an exchange: the records that are sent are those that are received, and all rows."""
    items = _items(spark, d, "l_orderkey", "l_quantity")
    with stage_metrics(spark) as m:
        items.repartition(5, "l_orderkey").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(m["shuffle_write_records"], m["shuffle_read_records"], m["shuffle_write_bytes"] > 0)], "written long, read long, bytes_counted boolean")


def options_in_effect(spark, d):
    """The options of the store and of exchanges, as a session has them that sets one of them."""
    session = spark.newSession()
    session.conf.set("shuffleframe.store.cacheSize", "3")
    return session.createDataFrame([(k, None if (x := option(session, k)) is None else str(x).lower()) for k in OPTIONS if OPTIONS[k].ours], "key string, value string")


def store_drop_map(spark, d):
    store = _store(spark)
    store.put(_items(spark, d, "l_orderkey", "l_linenumber"), 1, ExchangeSpec(("l_orderkey",), N), map_id=F.col("l_linenumber"))
    store.drop_map(1, 3)
    return store.read(1).groupBy(F.col("map_id").cast("long").alias("map_id"), F.col("reduce_id").cast("long").alias("reduce_id")).agg(F.count(F.lit(1)).alias("n_rows"))


def store_dump_partition(spark, d):
    store = _store(spark)
    store.put(_items(spark, d, "l_orderkey", "l_partkey", "l_quantity"), 1, ExchangeSpec(("l_orderkey",), N))
    return spark.read.parquet(store.dump(1, 3)).select("l_orderkey", "l_partkey", "l_quantity")


def batch_limit_read(spark, d):
    batched = runs.with_batches(_orders(spark, d, "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], BATCH)
    return runs.limit_batches(batched, 1, 3)


def spill_batch_offsets(spark, d):
    batched = runs.with_batches(_orders(spark, d, "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], BATCH)
    lengths = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("length")).withColumn("run", F.floor(F.col("batch") / 1024))
    # offsets within runs of 1024 batches
    return manifest.lengths_to_offsets(lengths, ["run"], "batch").select("run", "batch", "length", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def skew_report(spark, d):
    sizes = partition.partition_sizes(partition.exchange(_items(spark, d, "l_suppkey"), ExchangeSpec(("l_suppkey",), N)), N)
    return partition.skew_report(sizes).select("partitions", "total_rows", "largest", F.round("mean", 6).alias("mean"), F.round("skew", 6).alias("skew"))


def strategy_choice(spark, d):
    """Which writer an exchange of as many partitions as each nation's key, times 100, would take, with and without map-side combine."""
    nations = _read(spark, d, "nation").select((F.col("n_nationkey") * 100).cast("long").alias("num_partitions")).withColumn("combine", F.explode(F.array(F.lit(False), F.lit(True))))
    return strategies(nations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hash_partition_sizes, partition_sizes_with_empties, skip_empty_partitions, round_robin_balance, partition_range_read,
        reduce_by_key_sum, reduce_by_key_max, reduce_by_key_count, ordered_aggregate, two_phase_aggregate, combine_by_key_avg,
        group_by_key_list, cogroup_orders_lineitem, hash_collision_group, null_key_group, struct_field_sum,
        sort_within_partition, range_partition_sort, descending_sort, range_partition_disjoint, kway_merge,
        map_status, lengths_to_offsets, offsets_to_lengths, manifest_validate, index_file_roundtrip, partition_checksum,
        store_roundtrip, store_range_read, store_lengths, store_recommit, store_drop_map, store_dump_partition,
        batch_limit_read, spill_batch_offsets, skew_report, strategy_choice,
        hash_order_sort, group_by_key_chunks, index_partitions, store_invalid_commit, store_skipped_partitions, store_read_around_damage,
        store_dump_on_error, store_codecs, store_backends, store_second_session, store_life, stream_into_store,
        perf_report, exchange_metrics, options_in_effect,
    )
}

_LENGTHS = "select cast(l_linenumber as bigint) map_id, l_orderkey % 7 reduce_id, count(*) length from lineitem group by 1, 2"
_ENDS = f"select map_id, reduce_id, length, cast(sum(length) over (partition by map_id order by reduce_id) as bigint) as \"end\" from ({_LENGTHS})"
_BATCHED = "select o_orderkey, o_custkey, cast((row_number() over (order by o_custkey, o_orderkey) - 1) // 1000 as bigint) batch from orders"
_HASH = "cast('0x' || substr(md5(l_orderkey::varchar || ':' || l_partkey::varchar), 1, 8) as bigint)"

ORACLES: dict[str, str] = {
    "hash_partition_sizes": "select l_orderkey % 7 reduce_id, count(*) n_rows from lineitem group by 1",
    "partition_sizes_with_empties": "select i reduce_id, count(l_linenumber) n_rows from range(11) t(i) left join lineitem on l_linenumber % 11 = i group by 1",
    "skip_empty_partitions": "select cast(l_linenumber % 11 as bigint) reduce_id, count(*) n_rows from lineitem group by 1",
    "round_robin_balance": "select cast(8 as bigint) partitions, count(*) total_rows, true balanced from lineitem",
    "partition_range_read": "select l_orderkey, l_partkey, l_quantity from lineitem where l_orderkey % 7 between 2 and 4",
    "reduce_by_key_sum": "select l_orderkey, sum(l_quantity) sum_qty from lineitem group by 1",
    "reduce_by_key_max": "select l_orderkey, max(l_extendedprice) max_price from lineitem group by 1",
    "reduce_by_key_count": "select l_suppkey, count(*) n from lineitem group by 1",
    "ordered_aggregate": "select l_partkey, sum(l_quantity) sum_qty, l_partkey % 7 as \"partition\", row_number() over (partition by l_partkey % 7 order by l_partkey) - 1 as \"position\" from lineitem group by l_partkey",
    "two_phase_aggregate": "select l_orderkey, sum(l_quantity) sum_qty, count(*) n from lineitem group by 1",
    "combine_by_key_avg": "select l_partkey, round(avg(l_quantity), 6) avg_qty from lineitem group by 1",
    "group_by_key_list": "select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_partkey) parts from lineitem group by 1",
    "cogroup_orders_lineitem": "select coalesce(a.k, b.k) k, coalesce(left_values, '') left_values, coalesce(right_values, '') right_values from (select o_orderkey k, string_agg(o_custkey::varchar, ',' order by o_custkey) left_values from orders group by 1) a full join (select l_orderkey k, string_agg(l_partkey::varchar, ',' order by l_partkey) right_values from lineitem group by 1) b on a.k = b.k",
    "hash_collision_group": "select l_partkey % 2 h, l_partkey v, count(*) n from lineitem group by 1, 2",
    "null_key_group": "select nullif(l_orderkey % 5, 0) k, count(*) n, sum(l_quantity) sum_qty from lineitem group by 1",
    "struct_field_sum": "select l_suppkey, cast(sum(l_linenumber) as bigint) sum_v, cast(sum(10) as bigint) sum_h from lineitem group by 1",
    "sort_within_partition": "select o_orderkey, o_orderkey % 7 as \"partition\", row_number() over (partition by o_orderkey % 7 order by o_totalprice desc, o_orderkey) - 1 as \"position\" from orders",
    "range_partition_sort": "select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) - 1 row_index from orders",
    "descending_sort": "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 1 row_index from orders",
    "range_partition_disjoint": "select count(*) total_rows, true in_order, cast(0 as bigint) n_overlaps from orders",
    "kway_merge": "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 row_index from orders",
    "map_status": _LENGTHS,
    "lengths_to_offsets": f"select map_id, reduce_id, length, \"end\" - length as \"start\", \"end\" from ({_ENDS})",
    "offsets_to_lengths": _LENGTHS,
    "manifest_validate": f"select map_id, count(*) n_partitions, cast(sum(length) as bigint) total, cast(sum(length) - map_id % 2 as bigint) data_size, map_id % 2 = 0 valid from ({_LENGTHS}) group by map_id",
    "index_file_roundtrip": f"select map_id, reduce_id, lower(lpad(to_hex(\"end\"), 16, '0')) word, \"end\" from ({_ENDS})",
    "partition_checksum": f"select l_orderkey % 7 reduce_id, count(*) n_rows, cast(sum({_HASH}) as bigint) hash_sum, bit_xor({_HASH}) hash_xor from lineitem group by 1",
    "store_roundtrip": "select l_orderkey % 7 reduce_id, count(*) n_rows, sum(l_quantity) sum_qty from lineitem group by 1",
    "store_range_read": "select l_orderkey % 7 reduce_id, l_orderkey, l_partkey from lineitem where l_orderkey % 7 between 2 and 4",
    "store_lengths": "select i reduce_id, count(l_linenumber) n_rows from range(11) t(i) left join lineitem on l_linenumber % 11 = i group by 1",
    "store_recommit": "select l_orderkey % 7 reduce_id, count(*) n_rows, min(l_quantity) min_qty from lineitem where l_quantity > 10 group by 1",
    "store_drop_map": "select cast(l_linenumber as bigint) map_id, l_orderkey % 7 reduce_id, count(*) n_rows from lineitem where l_linenumber <> 3 group by 1, 2",
    "store_dump_partition": "select l_orderkey, l_partkey, l_quantity from lineitem where l_orderkey % 7 = 3",
    "batch_limit_read": f"select o_orderkey, o_custkey, batch from ({_BATCHED}) where batch >= 1 and batch < 3",
    "spill_batch_offsets": f"select batch // 1024 run, batch, length, cast(sum(length) over (partition by batch // 1024 order by batch) - length as bigint) as \"start\", cast(sum(length) over (partition by batch // 1024 order by batch) as bigint) as \"end\" from (select batch, count(*) length from ({_BATCHED}) group by batch)",
    "skew_report": "select count(*) partitions, cast(sum(n) as bigint) total_rows, max(n) largest, round(avg(n), 6) mean, round(max(n) / avg(n), 6) skew from (select l_suppkey % 7, count(*) n from lineitem group by 1)",
    "hash_order_sort": "select count(*) total_rows, cast(0 as bigint) out_of_order, count(distinct o_custkey) runs_of_keys from orders",
    "group_by_key_chunks": "select cast(l_linenumber as bigint) l_linenumber, cast(ceil(count(*) / 100) as bigint) chunks, count(*) n_values, least(count(*), 100) largest, min(l_orderkey) low, max(l_orderkey) high from lineitem group by 1",
    "index_partitions": f"select map_id, reduce_id, \"end\" - length as \"start\", length, upper(md5(repeat(reduce_id::varchar, cast(length as int)))) as md5, true as valid from ({_ENDS}) where reduce_id between 2 and 4",
    "store_invalid_commit": "select l_orderkey % 7 reduce_id, count(*) n_rows, max(l_quantity) max_qty, false taken from lineitem where l_quantity <= 10 group by 1",
    "store_skipped_partitions": "select cast(l_linenumber as bigint) map_id, l_orderkey % 7 reduce_id, count(*) told_rows, cast(0 as bigint) found_rows from lineitem where l_orderkey % 7 = 3 group by 1, 2",
    "store_read_around_damage": "select l_orderkey % 7 reduce_id, count(*) n_rows, sum(l_quantity) sum_qty from lineitem where l_orderkey % 7 in (2, 3, 5) group by 1",
    "store_dump_on_error": "select 'shuffle_1_4' dump, true failed, cast(7 as bigint) bytes",
    "store_codecs": "select codec, l_orderkey % 7 reduce_id, sum(l_quantity) sum_qty from lineitem cross join (values ('uncompressed'), ('snappy'), ('zstd'), ('gzip')) t(codec) group by 1, 2",
    "store_backends": "select backend, l_orderkey % 7 reduce_id, sum(l_quantity) sum_qty from lineitem cross join (values ('fs'), ('arrow')) t(backend) where l_orderkey % 7 between 1 and 3 group by 1, 2",
    "store_second_session": "select case when l_quantity <= 10 then 'before' else 'after' end step, count(*) n_rows from lineitem group by 1",
    "store_life": "select step, cast(committed as bigint) committed, cast(temporary as bigint) temporary, cast(heard as bigint) heard from (values ('written', 0, 1, 1), ('committed', 2, 0, 1), ('recalled', 2, 0, 1), ('dropped', 1, 0, 1), ('closed', 0, 0, 2)) t(step, committed, temporary, heard)",
    "stream_into_store": "select l_orderkey % 7 reduce_id, count(*) n_rows, sum(l_quantity) sum_qty from lineitem group by 1",
    "perf_report": "select cast(4 * 5 as bigint) blocks_read, '262.14K' bytes_written, '262.14K' bytes_read, '13.11K' partition_size",
    "exchange_metrics": "select count(*) as written, count(*) as \"read\", true bytes_counted from lineitem",
    "options_in_effect": "select * from (values ('shuffleframe.store.backend', 'fs'), ('shuffleframe.store.root', null), ('shuffleframe.store.clearOnClose', 'true'), ('shuffleframe.store.cacheSize', '3'), ('shuffleframe.store.pointerSeconds', '60.0'), ('shuffleframe.store.compression', null)) t(key, value)",
    "strategy_choice": "select cast(n_nationkey * 100 as bigint) num_partitions, c combine, case when c then 'base' when n_nationkey * 100 <= 200 then 'bypass' else 'serialized' end strategy from nation cross join (values (false), (true)) t(c)",
}
