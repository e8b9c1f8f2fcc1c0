"""Measures writing and reading of an exchange store: python -m shuffleframe.perf -m 200 -r 200 -d 64 -t 8 -o"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.manifest import size_string
from .plans.spec import ExchangeSpec
from .sources.store import ExchangeStore
from .storage import BACKENDS

APP = "perf"


@dataclass(frozen=True)
class PerfOptions:
    shuffle_id: int = 1
    tasks: int = 5
    mappers: int = 10
    reducers: int = 10
    blocks: int = 1024
    block_size: int = 262_144
    overwrite: bool = False
    read_only: bool = False
    backend: str = "fs"
    root: str | None = None
    scale: int = 1024
    compression: str = "uncompressed"

    @property
    def total_bytes(self) -> int:
        return self.mappers * self.reducers * (self.blocks * self.block_size // self.reducers)


def parse(args: list[str]) -> PerfOptions:
    d = PerfOptions()
    p = argparse.ArgumentParser("shuffleframe.perf")
    p.add_argument("-f", "--factory", dest="backend", default=d.backend, choices=sorted(BACKENDS))
    p.add_argument("-i", "--shuffleId", dest="shuffle_id", type=int, default=d.shuffle_id)
    p.add_argument("-t", "--tasks", type=int, default=d.tasks, help="concurrent tasks")
    p.add_argument("-m", "--mappers", type=int, default=d.mappers)
    p.add_argument("-r", "--reducers", type=int, default=d.reducers)
    p.add_argument("-d", "--data", dest="blocks", type=int, default=d.blocks, help="blocks of each mapper")
    p.add_argument("-b", "--blockSize", dest="block_size", type=int, default=d.block_size, help="bytes of a block")
    p.add_argument("-o", "--overwrite", action="store_true")
    p.add_argument("-ro", "--ro", "--readOnly", dest="read_only", action="store_true")
    p.add_argument("--root", default=None)
    p.add_argument("--compression", default=d.compression, help="codec of the data files; the data are random bytes")
    p.add_argument("--scale", type=int, default=d.scale, choices=(1000, 1024), help="of the units in the report")
    return PerfOptions(**vars(p.parse_args(args)))


def _rows(o: PerfOptions):
    per_block = o.blocks * o.block_size // o.reducers
    step = max(1, min(o.reducers, (1 << 20) // max(per_block, 1)))  # blocks of a batch

    def run(batches):
        for rows in batches:
            for m in rows.column(0).to_pylist():
                rng = np.random.default_rng([o.shuffle_id, m])
                for r in range(0, o.reducers, step):
                    n = min(step, o.reducers - r)
                    data = pa.array([rng.bytes(per_block) for _ in range(n)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int32()), pa.array(range(r, r + n), pa.int32()), data], names=["mapper", "r", "data"])

    return run


def write_phase(spark: SparkSession, store: ExchangeStore, o: PerfOptions) -> float:
    """Writes each mapper's random bytes, an equal part to each reducer; seconds."""
    if store._pointer(o.shuffle_id) and not o.overwrite:
        raise FileExistsError(f"exchange {o.shuffle_id} is there; overwrite it with -o")
    began = time.perf_counter()
    made = spark.range(0, o.mappers, 1, o.mappers).mapInArrow(_rows(o), "mapper int, r int, data binary")
    store.put(made, o.shuffle_id, ExchangeSpec(("r",), o.reducers), map_id=F.col("mapper"), layout="map")
    return time.perf_counter() - began


def read_phase(store: ExchangeStore, o: PerfOptions) -> tuple[float, int, int]:
    """Reads every block of a mapper and a reducer once: seconds, blocks, bytes."""
    began = time.perf_counter()
    got = store.read(o.shuffle_id).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data") + F.crc32("data") * 0).alias("bytes")).first()
    return time.perf_counter() - began, got.n, got.bytes or 0


def execute(spark: SparkSession, o: PerfOptions) -> dict:
    store = ExchangeStore(spark, o.root, APP, o.backend, clear_on_close=False, compression=o.compression)
    report: dict = {"options": asdict(o)}
    size = lambda n: size_string(n, o.scale)
    if not o.read_only:
        s = write_phase(spark, store, o)
        report |= {"write_s": round(s, 3), "bytes_written": size(o.total_bytes), "write_bandwidth": f"{size(o.total_bytes / s)}B/s"}
    s, blocks, n = read_phase(store, o)
    return report | {"read_s": round(s, 3), "blocks_read": blocks, "bytes_read": size(n), "read_bandwidth": f"{size(n / s)}B/s", "partition_size": size(n / max(blocks, 1))}


def main(args: list[str] | None = None) -> int:
    o = parse(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.master(f"local[{o.tasks}]").appName("shuffleframe.perf").config("spark.ui.enabled", "false").getOrCreate()
    print(json.dumps(execute(spark, o)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
