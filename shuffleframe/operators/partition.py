"""Partition ids, exchanges, and what lies in the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..plans.spec import ExchangeSpec
from ..storage import materialise


def reduce_id(df: DataFrame, keys: tuple[str, ...], n: int, mode: str = "mod") -> Column:
    """The partition, 0 to n - 1, of each row. mod: of one whole-number key itself, of other keys as murmur3; murmur3: of Spark's hash. A null key is in partition 0."""
    whole = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, ByteType | ShortType | IntegerType | LongType)
    value = F.col(keys[0]) if mode == "mod" and whole else F.hash(*keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.pmod(value, F.lit(n)).cast("int")).otherwise(F.lit(0))


def with_reduce_id(df: DataFrame, keys: tuple[str, ...] | list[str], n: int, mode: str = "mod") -> DataFrame:
    """df with the column reduce_id. mode range is an exchange of its own: rows lie in the partition that they name."""
    keys = tuple(keys)
    if mode == "range":
        return df.repartitionByRange(n, *keys).withColumn("reduce_id", F.spark_partition_id())
    return df.withColumn("reduce_id", reduce_id(df, keys, n, mode))


def exchange(df: DataFrame, spec: ExchangeSpec, start: int | None = None, end: int | None = None) -> DataFrame:
    """df dealt to spec.num_partitions partitions, sorted within each if order_by is given. One shuffle; the number of partitions is kept as asked for.

    With start and end only the rows of the partitions start to end - 1 are sent, the others are empty; not for ranges and round robin, whose partitions are known only after they are dealt.
    """
    n = spec.num_partitions
    if start is not None or end is not None:
        if spec.mode not in ("mod", "murmur3"):
            raise ValueError("only a partition that a row's key tells can be left out before the exchange")
        to = reduce_id(df, spec.keys, n, spec.mode)
        df = df.where((to >= (start or 0)) & (to < (n if end is None else end)))
    if spec.mode == "round_robin":
        dealt = df.repartition(n)
    elif spec.mode == "range":
        dealt = df.repartitionByRange(n, *spec.keys)
    else:
        dealt = df.repartitionById(n, reduce_id(df, spec.keys, n, spec.mode))
    return dealt.sortWithinPartitions(*spec.order_by) if spec.order_by else dealt


def together(df: DataFrame, column: str, n: int, check: str) -> DataFrame:
    """df dealt for a write by column, whose values are 0 to n - 1: a value's rows lie in few tasks, but a task's share doesn't grow with the value's rows.

    Adaptive execution splits what is larger than spark.sql.adaptive.advisoryPartitionSizeInBytes, by the tasks that its rows come from. Where the session has
    it off, each value has an equal part of spark.sql.shuffle.partitions, and check, a hash of the row, deals its rows to these: alike in a repeated attempt.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        # more parts than values, so that few values share one; of more than 2000 parts Spark knows the mean size only
        return df.hint("rebalance", max(n, min(8 * n, 2000)), column)
    parts = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    task = F.col(column) * parts + F.pmod(F.xxhash64(check, F.spark_partition_id()), F.lit(parts)).cast("int")
    return df.withColumn("__task", task).repartitionById(n * parts, F.col("__task")).drop("__task")


def placed(df: DataFrame) -> DataFrame:
    """df with where its rows physically lie: partition, and position in it from 0."""
    return df.withColumn("partition", F.spark_partition_id()).withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def partition_sizes(df: DataFrame, n: int | None = None, include_empty: bool = True) -> DataFrame:
    """(reduce_id, n_rows) for the partitions that rows of df lie in; with include_empty also the empty ones of n."""
    sizes = df.select(F.spark_partition_id().alias("reduce_id")).groupBy("reduce_id").agg(F.count(F.lit(1)).alias("n_rows"))
    if not include_empty:
        return sizes
    if n is None:
        raise ValueError("the number of partitions is needed to name the empty ones")
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("reduce_id"))
    return every.join(sizes, "reduce_id", "left").select("reduce_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def read_partitions(df: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of df that lie in the partitions start to end - 1."""
    part = F.spark_partition_id()
    return df.where((part >= start) & (part < end))


def skew_report(sizes: DataFrame) -> DataFrame:
    """One row about (reduce_id, n_rows): partitions, total, largest, mean, and the largest as times the mean."""
    return sizes.agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n_rows").alias("total_rows"), F.max("n_rows").alias("largest"), F.avg("n_rows").alias("mean"), (F.max("n_rows") / F.avg("n_rows")).alias("skew")
    )


def row_index(df: DataFrame, order_by: list[str | Column], n: int | None = None, name: str = "row_index") -> DataFrame:
    """df with each row's number, from 0, in the order given. Rows are dealt by ranges and sorted in them, and numbered as they then lie."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return row_index_as_placed(df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by), name)


def row_index_as_placed(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with each row's number, from 0, by partition and position, for rows that lie in order already. The numbers of rows in earlier partitions (one number a partition) are added, so no task sees all rows."""
    lying = materialise(placed(df))
    counts = sorted((r.partition, r.n) for r in lying.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for part, k in counts:
        rows.append((part, before))
        before += k
    offsets = df.sparkSession.createDataFrame(rows, "partition int, __before long")
    return lying.join(F.broadcast(offsets), "partition").withColumn(name, F.col("__before") + F.col("position")).drop("__before", "position", "partition")
