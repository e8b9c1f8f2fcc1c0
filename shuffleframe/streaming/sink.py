"""A stream's micro-batches as exchanges of a store, each committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.spec import ExchangeSpec
from ..sources.store import ExchangeStore


def into_store(stream: DataFrame, store: ExchangeStore, spec: ExchangeSpec, first_id: int = 0) -> DataStreamWriter:
    """Writes micro-batch b as exchange first_id + b. A batch that the stream repeats after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        store.put(df, first_id + number, spec)

    return stream.writeStream.foreachBatch(batch)
