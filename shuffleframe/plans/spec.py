"""The logical description of an exchange, and which of Spark's shuffle writers it would take."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("mod", "murmur3", "range", "round_robin")
#: The most partitions that Spark's serialized shuffle writer takes.
MAX_SERIALIZED_PARTITIONS = 1 << 24


@dataclass(frozen=True)
class ExchangeSpec:
    """keys decide the partition (mod: the key itself, murmur3: its hash, range: its order; round_robin has none); order_by sorts within each partition."""

    keys: tuple[str, ...] = ()
    num_partitions: int = 200
    mode: str = "mod"
    order_by: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if self.num_partitions < 1:
            raise ValueError("an exchange has one partition at least")
        if (self.mode == "round_robin") == bool(self.keys):
            raise ValueError("round_robin has no keys, every other mode has some")


def explain_strategy(num_partitions: int, map_side_combine: bool, relocatable: bool = True, threshold: int = 200, aggregator: bool | None = None) -> str:
    """bypass (a file a partition, no sort), serialized (sorts bytes by partition), or base (sorts records).

    As Spark chooses: bypass without map-side combine up to the threshold; serialized if records can be moved as bytes and the exchange itself doesn't aggregate.
    """
    aggregates = map_side_combine if aggregator is None else aggregator
    if map_side_combine and not aggregates:
        raise ValueError("map-side combine needs an aggregator")
    if not map_side_combine and num_partitions <= threshold:
        return "bypass"
    if relocatable and not aggregates and num_partitions <= MAX_SERIALIZED_PARTITIONS:
        return "serialized"
    return "base"


def strategies(counts: DataFrame, num_partitions: str = "num_partitions", combine: str = "combine", name: str = "strategy") -> DataFrame:
    """counts with explain_strategy() of the columns num_partitions and combine (boolean), evaluated by that function itself, a batch at a time."""

    @F.pandas_udf("string")
    def chosen(n: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([explain_strategy(int(x), bool(y)) for x, y in zip(n, c, strict=True)], dtype=object)

    return counts.withColumn(name, chosen(num_partitions, combine))
