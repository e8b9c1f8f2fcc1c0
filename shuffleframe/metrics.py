"""What the stages that ran meanwhile read, wrote and spilled, from Spark's status store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Names here and in the status store.
FIELDS = {
    "tasks": "numCompleteTasks",
    "shuffle_read_bytes": "shuffleReadBytes",
    "shuffle_read_records": "shuffleReadRecords",
    "shuffle_write_bytes": "shuffleWriteBytes",
    "shuffle_write_records": "shuffleWriteRecords",
    "shuffle_write_ns": "shuffleWriteTime",
    "memory_spilled_bytes": "memoryBytesSpilled",
    "disk_spilled_bytes": "diskBytesSpilled",
    "input_bytes": "inputBytes",
    "input_records": "inputRecords",
}


def _stages(spark: SparkSession) -> dict[tuple[int, int], dict[str, int]]:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    seq = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    out = {}
    for i in range(seq.size()):
        s = seq.apply(i)
        out[s.stageId(), s.attemptId()] = {k: getattr(s, name)() for k, name in FIELDS.items()} | {"peak_memory_bytes": s.peakExecutionMemory()}
    return out


@contextmanager
def stage_metrics(spark: SparkSession) -> Iterator[dict[str, int]]:
    """Gives a dict that holds, once the block has ended, the sums over the stages that ran in it (peak_memory_bytes: the largest)."""
    before = set(_stages(spark))
    result: dict[str, int] = {}
    yield result
    new = [v for k, v in _stages(spark).items() if k not in before]
    result["stages"] = len(new)
    for k in FIELDS:
        result[k] = sum(v[k] for v in new)
    result["peak_memory_bytes"] = max((v["peak_memory_bytes"] for v in new), default=0)
