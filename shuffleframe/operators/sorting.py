"""Sorts within partitions, over all, and of runs that are merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import ExchangeSpec
from .partition import exchange, reduce_id


def partition_sort(df: DataFrame, keys: list[str], n: int, order_by: list[str | Column] | None = None) -> DataFrame:
    """df dealt by key and sorted within each partition, without a global order."""
    return exchange(df, ExchangeSpec(tuple(keys), n)).sortWithinPartitions(*(order_by or keys))


def aggregate_sort(df: DataFrame, keys: list[str], aggs: dict[str, Column], n: int, by: str = "mod", order_by: list[str | Column] | None = None) -> DataFrame:
    """Aggregates by keys, dealt by key and sorted within each partition, in one exchange: as rows of a key lie in one partition, they are aggregated and sorted where they lie."""
    dealt = df.withColumn("__to", reduce_id(df, tuple(keys), n, by)).repartitionById(n, F.col("__to"))
    return dealt.groupBy("__to", *keys).agg(*[c.alias(name) for name, c in aggs.items()]).drop("__to").sortWithinPartitions(*(order_by or keys))


def hash_sort(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df dealt by key and sorted within each partition by the key's hash, keys of equal hash by themselves: rows of a key lie together, without a comparison of most keys."""
    return exchange(df, ExchangeSpec(tuple(keys), n)).sortWithinPartitions(F.hash(*keys), *keys)


def sort_by_key(df: DataFrame, keys: list[str], ascending: bool = True, n: int | None = None) -> DataFrame:
    """df in n ranges of keys, each sorted: partition by partition the rows are in order. Duplicates stay."""
    order = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    ranges = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order)


def kway_merge(runs: list[DataFrame], keys: list[str], n: int | None = None) -> DataFrame:
    """The rows of all runs in key order, duplicates kept, as Spark merges sorted runs when it sorts the ranges."""
    return sort_by_key(reduce(DataFrame.unionByName, runs), keys, n=n)
