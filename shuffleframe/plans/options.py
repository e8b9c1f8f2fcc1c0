"""All options with their defaults. ExchangeStore.configured() goes by the store's, Spark itself by the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Option:
    key: str
    default: object
    ours: bool = False


#: Options of the exchange store (ours) and the Spark options that decide how an exchange runs.
OPTIONS = {
    o.key: o
    for o in (
        Option("shuffleframe.store.backend", "fs", True),
        Option("shuffleframe.store.root", None, True),
        Option("shuffleframe.store.clearOnClose", True, True),
        Option("shuffleframe.store.cacheSize", 10, True),
        Option("shuffleframe.store.pointerSeconds", 60.0, True),
        Option("shuffleframe.store.compression", None, True),
        Option("spark.shuffle.spill.numElementsForceSpillThreshold", 2**31 - 1),
        Option("spark.shuffle.sort.useRadixSort", True),
        Option("spark.shuffle.spill.batchSize", 10_000),
        Option("spark.shuffle.unsafe.fastMergeEnabled", True),
        Option("spark.shuffle.compress", True),
        Option("spark.shuffle.sort.initialBufferSize", 4096),
        Option("spark.storage.memoryMapThreshold", 2 << 20),
        Option("spark.shuffle.file.buffer", 32 << 10),
        Option("spark.shuffle.sort.bypassMergeThreshold", 200),
    )
}


def option(spark: SparkSession, key: str):
    """The session's value of an option, in the type of its default, or the default."""
    known = OPTIONS[key]
    got = spark.conf.get(key, None)
    if got is None:
        got = spark.sparkContext.getConf().get(key)
    if got is None:
        return known.default
    if isinstance(known.default, bool):
        return str(got).lower() == "true"
    return type(known.default)(got) if known.default is not None else got
