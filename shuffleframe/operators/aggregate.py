"""Keyed aggregation: Spark combines on the map side, exchanges by key, and merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise


def reduce_by_key(df: DataFrame, keys: list[str], aggs: dict[str, Column], order_by: list[str] | None = None) -> DataFrame:
    """One row a key with the aggregates named; nulls are one key. Unordered unless order_by sorts each partition."""
    out = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return out.sortWithinPartitions(*order_by) if order_by else out


def group_by_key(df: DataFrame, keys: list[str], value: str, name: str | None = None, limit: int | None = None) -> DataFrame:
    """One row a key with the sorted list of its values, nulls left out. The list is one row: for keys with very many rows use reduce_by_key or group_by_key_in_chunks.

    limit: a key with more values is an error, which is raised from the counts, before any list is made.
    """
    if limit is not None:
        counts = df.groupBy(*keys).agg(F.count(value).alias("__n")).where(F.col("__n") > limit)
        over = counts.agg(F.count(F.lit(1)).alias("keys"), F.max("__n").alias("most")).first()
        if over["keys"]:
            raise ValueError(f"{over['keys']} keys have more than {limit} values, one has {over.most}; see group_by_key_in_chunks")
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name or value))


def group_by_key_in_chunks(df: DataFrame, keys: list[str], value: str, size: int, name: str | None = None) -> DataFrame:
    """(keys, chunk, list): as group_by_key, but the values of a key with more than size are spread over chunks 0, 1, ... of size or fewer.

    Rows get a number within their partition and key, and the numbers are shifted by what earlier partitions hold of the key, so no task gathers a hot key: a chunk is the largest thing in memory. Lists are sorted; which value is in which chunk isn't defined.
    """
    if size < 1:
        raise ValueError("a chunk has one value at least")
    lying = materialise(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__value"), F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    held = lying.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    shifts = held.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    numbered = lying.withColumn("__k", F.row_number().over(W.partitionBy("__part", *keys).orderBy("__at")) - 1)
    a, b = numbered.alias("a"), shifts.alias("b")
    on = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    placed = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.floor((F.col("__k") + F.col("__before")) / size).cast("long").alias("chunk"), "__value")
    return placed.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("__value")).alias(name or value))


def combine_by_key(df: DataFrame, keys: list[str], create: dict[str, Column], merge: dict[str, Callable[[Column], Column]], finish: dict[str, Column], parts: Column | None = None) -> DataFrame:
    """Aggregation through combiners.

    create: the combiner's columns as aggregates over raw rows; merge: for each, the aggregate that merges combiners; finish: result columns over merged combiners. parts splits a key's rows into combiners that are merged after, which salts hot keys; the result is the same for any split.
    """
    if parts is None:
        merged = df.groupBy(*keys).agg(*[c.alias(k) for k, c in create.items()])
    else:
        partial = df.withColumn("__part", parts).groupBy(*keys, "__part").agg(*[c.alias(k) for k, c in create.items()])
        merged = merge_partials(partial.drop("__part"), keys, merge)
    return merged.select(*keys, *[c.alias(k) for k, c in finish.items()])


def merge_partials(df: DataFrame, keys: list[str], merges: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Merges rows that are combined already: columns named in merges, each by its aggregate."""
    return df.groupBy(*keys).agg(*[f(F.col(k)).alias(k) for k, f in merges.items()])


def cogroup(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str) -> DataFrame:
    """(keys, left_values, right_values): sorted lists of both sides for keys of either; a side without the key has an empty list. Null keys are one key."""
    sides = [df.groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias(name)) for df, v, name in ((left, left_value, "left_values"), (right, right_value, "right_values"))]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    empty = F.array().cast(sides[0].schema["left_values"].dataType), F.array().cast(sides[1].schema["right_values"].dataType)
    return a.join(b, on, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.coalesce("left_values", empty[0]).alias("left_values"), F.coalesce("right_values", empty[1]).alias("right_values"))
