"""Runs of rows in batches, as a spilled file holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partition import row_index


def with_batches(df: DataFrame, order_by: list[str], batch: int) -> DataFrame:
    """df with the number of each row's batch, batches of so many rows in the order given."""
    if batch < 1:
        raise ValueError("a batch has one row at least")
    return row_index(df, order_by, name="__row").withColumn("batch", F.floor(F.col("__row") / batch).cast("long")).drop("__row")


def limit_batches(batched: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the batches start to end - 1; an empty or negative range has none."""
    return batched.where((F.col("batch") >= max(start, 0)) & (F.col("batch") < end))
