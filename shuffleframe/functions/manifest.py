"""Lengths, offsets and index files of partitioned output."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lengths_to_offsets(lengths: DataFrame, by: list[str], order: str, length: str = "length") -> DataFrame:
    """lengths with start and end: the running sums before and after each partition of its map output (the columns by)."""
    running = F.sum(length).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return lengths.withColumn("end", running).withColumn("start", F.col("end") - F.col(length))


def offsets_to_lengths(offsets: DataFrame, by: list[str], order: str, offset: str = "offset") -> DataFrame:
    """Partitions with their length, from n + 1 offsets of each map output; the last offset ends the last partition."""
    following = F.lead(offset).over(W.partitionBy(*by).orderBy(order))
    return offsets.withColumn("length", following - F.col(offset)).where("length is not null")


def validate(offsets: DataFrame, sizes: DataFrame, by: list[str], order: str, offset: str = "offset", size: str = "data_size") -> DataFrame:
    """(by, n_partitions, total, data_size, valid): valid if the first offset is 0, none falls, and the last is the data's size; outputs that miss on one side are invalid."""
    fell = F.col(offset) < F.lag(offset).over(W.partitionBy(*by).orderBy(order))
    checked = offsets.withColumn("__fell", F.coalesce(fell, F.lit(False)))
    found = checked.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("n_partitions"), F.min_by(offset, order).alias("__first"), F.max_by(offset, order).alias("total"), F.max("__fell").alias("__fell"))
    valid = (F.col("__first") == 0) & ~F.col("__fell") & (F.col("total") == F.col(size))
    return found.join(sizes, by, "full").select(*by, "n_partitions", "total", size, F.coalesce(valid, F.lit(False)).alias("valid"))


def encode_index(lengths: list[int]) -> bytes:
    """An index file: n + 1 running sums as big-endian whole numbers of 64 bits; empty for no data at all."""
    if any(x < 0 for x in lengths):
        raise ValueError("a length is negative")
    if not sum(lengths):
        return b""
    offsets = [0]
    for x in lengths:
        offsets.append(offsets[-1] + x)
    return struct.pack(f">{len(offsets)}q", *offsets)


def decode_index(data: bytes) -> list[int]:
    """The offsets of an index file."""
    if len(data) % 8:
        raise ValueError("an index file holds whole numbers of 64 bits")
    return list(struct.unpack(f">{len(data) // 8}q", data))


def check_index(data: bytes | None, data_size: int) -> list[int] | None:
    """The partitions' lengths; None for a missing or empty index, or one that doesn't fit the data."""
    offsets = decode_index(data) if data else []
    if not offsets or offsets[0] != 0 or offsets[-1] != data_size or any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        return None
    return [b - a for a, b in zip(offsets, offsets[1:], strict=False)]


def size_string(n: float, scale: int = 1024) -> str:
    """A number of bytes with two decimals and a unit of scale (1024 or 1000) times the one before, the smallest in which no more than scale are left; without a unit, one decimal."""
    if scale not in (1000, 1024):
        raise ValueError("the scale is 1000 or 1024")
    value, units = float(n), ["", "K", "M", "G", "T"]
    while value > scale and len(units) > 1:
        value /= scale
        units.pop(0)
    return f"{value:.1f}" if units[0] == "" else f"{value:.2f}{units[0]}"
