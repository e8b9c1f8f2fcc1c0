"""A durable exchange store: partitioned output that outlives the executors that made it.

Layout, in any file system that Spark writes to:
    root/app_id/exchange/shuffle_id=S/attempt=UUID/data/reduce_id=R/*.parquet
    root/app_id/exchange/shuffle_id=S/attempt=UUID/manifest/*.parquet
    root/app_id/exchange/shuffle_id=S/CURRENT
That is the layout "reduce": rows are exchanged first, so a partition is one folder, of as many files as its size asks for
(in the modes range and round_robin of one). Rows are in the order of order_by within a file. The layout "map" writes without an
exchange: each task's rows go to one file, sorted by reduce_id, and a range read skips row groups and pages by their
smallest and largest reduce_id.
Data come first, with a checksum column that is made in the same pass; then the manifest (rows and a checksum of each
map and reduce partition), from the small columns only; and last the pointer CURRENT, a small file that names the attempt
that counts: it is the only commit point. Readers go by the pointer, so an attempt that failed is never seen. The attempt
that a commit replaces stays until the next commit, so that readers that hold it can end.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.partition import reduce_id, together, with_reduce_id
from ..plans.options import option
from ..plans.spec import ExchangeSpec
from ..storage import BACKENDS, shared_root

#: Bytes of a row group in the layout map: what a range read can skip.
ROW_GROUP = 16 << 20
#: Columns that the store adds to the data; columns of that name in the rows to write are replaced, the last one is never given out.
MAP_ID, REDUCE_ID, CHECK = "map_id", "reduce_id", "__check"


class CorruptExchange(RuntimeError):
    """Data that don't agree with their manifest."""


class MissingExchange(KeyError):
    """No committed attempt of this exchange."""


@dataclass(frozen=True)
class Listener:
    """Called when a store opens and when it closes."""

    on_start: Callable[[str], None] = lambda app_id: None
    on_end: Callable[[str], None] = lambda app_id: None


@dataclass(frozen=True)
class Attempt:
    shuffle_id: int
    uuid: str
    path: str
    num_partitions: int


def row_checksum(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


class ExchangeStore:
    """See configured() for a store by the session's options. compression: a codec of Spark's Parquet writer (None: the session's). A pointer is remembered for pointer_seconds at most, of cache_size exchanges."""

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        app_id: str | None = None,
        backend: str = "fs",
        clear_on_close: bool = True,
        cache_size: int = 10,
        listeners: tuple[Listener, ...] = (),
        compression: str | None = None,
        pointer_seconds: float = 60.0,
    ):
        if backend not in BACKENDS:
            raise ValueError(f"no backend {backend!r}; there are {sorted(BACKENDS)}")
        self.spark, self.app_id = spark, app_id or spark.sparkContext.applicationId
        self.root = (root or f"{shared_root(spark)}/exchanges").rstrip("/")
        self.clear_on_close, self.listeners, self.compression = clear_on_close, listeners, compression
        self._files = BACKENDS[backend](spark, self.root)
        self._pointers: OrderedDict[int, tuple[float, dict]] = OrderedDict()
        self._cache_size, self._pointer_seconds = cache_size, pointer_seconds
        for x in listeners:
            x.on_start(self.app_id)

    @classmethod
    def configured(cls, spark: SparkSession, **given) -> ExchangeStore:
        """A store by the options shuffleframe.store.* of the session; what is given goes before."""
        names = {"backend": "backend", "root": "root", "clear_on_close": "clearOnClose", "cache_size": "cacheSize", "compression": "compression", "pointer_seconds": "pointerSeconds"}
        return cls(spark, **({k: option(spark, f"shuffleframe.store.{name}") for k, name in names.items()} | given))

    def __enter__(self) -> ExchangeStore:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    # where things are

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.app_id}/exchange"

    def _shuffle(self, shuffle_id: int) -> str:
        return f"{self.folder}/shuffle_id={shuffle_id}"

    def _pointer(self, shuffle_id: int) -> dict | None:
        """What CURRENT says, remembered for a while for the exchanges read last; None without a commit."""
        since, known = self._pointers.get(shuffle_id, (0.0, None))
        if known is None or time.monotonic() - since > self._pointer_seconds:
            text = self._files.read(f"{self._shuffle(shuffle_id)}/CURRENT")
            self._pointers.pop(shuffle_id, None)
            if text is None:
                return None
            known = json.loads(text)
            self._pointers[shuffle_id] = (time.monotonic(), known)
            if len(self._pointers) > self._cache_size:
                self._pointers.popitem(last=False)
        else:
            self._pointers.move_to_end(shuffle_id)
        return known

    def invalidate(self, shuffle_id: int | None = None) -> None:
        """Forgets what is remembered of one exchange, or of all."""
        if shuffle_id is None:
            self._pointers.clear()
        else:
            self._pointers.pop(shuffle_id, None)

    # writing

    def write(self, df: DataFrame, shuffle_id: int, spec: ExchangeSpec, map_id: Column | None = None, layout: str = "reduce") -> Attempt:
        """Writes an attempt, which counts only once it is committed. layout: reduce or map (see above; map is for the modes mod and murmur3). map_id names the map output that a row comes from (default: the partition of df that it lies in). An error leaves no attempt behind."""
        if layout not in ("reduce", "map") or layout == "map" and spec.mode not in ("mod", "murmur3"):
            raise ValueError("layout is reduce, or map for an exchange by mod or murmur3")
        attempt = Attempt(shuffle_id, uuid.uuid4().hex, "", spec.num_partitions)
        attempt = Attempt(shuffle_id, attempt.uuid, f"{self._shuffle(shuffle_id)}/attempt={attempt.uuid}", spec.num_partitions)
        columns = [c for c in df.columns if c not in (MAP_ID, REDUCE_ID, CHECK)]
        marked = df.withColumns({MAP_ID: (F.spark_partition_id() if map_id is None else map_id).cast("int"), CHECK: row_checksum(columns) if columns else F.lit(0).cast("long")})
        try:
            if spec.mode == "range":
                dealt = with_reduce_id(marked, spec.keys, spec.num_partitions, "range")
            elif spec.mode == "round_robin":
                dealt = marked.repartition(spec.num_partitions).withColumn("reduce_id", F.spark_partition_id())
            else:
                dealt = marked.withColumn("reduce_id", reduce_id(df, spec.keys, spec.num_partitions, spec.mode))
                if layout == "reduce":
                    dealt = together(dealt, REDUCE_ID, spec.num_partitions, CHECK)
            if spec.order_by or layout == "map":
                dealt = dealt.sortWithinPartitions("reduce_id", *spec.order_by)
            writer = dealt.write.option("compression", self.compression) if self.compression else dealt.write
            if layout == "map":
                writer.option("parquet.block.size", ROW_GROUP).parquet(f"{attempt.path}/data")
            else:
                writer.partitionBy(REDUCE_ID).parquet(f"{attempt.path}/data")
            written = self.spark.read.schema(dealt.schema).parquet(f"{attempt.path}/data")
            self._summed(written, F.col(CHECK)).coalesce(1).write.parquet(f"{attempt.path}/manifest")
            self._files.replace(f"{attempt.path}/SCHEMA", dealt.schema.json())
            self._files.replace(f"{attempt.path}/FILES", json.dumps(self._sizes(attempt.path)))
        except BaseException:
            self.recall(attempt)
            raise
        return attempt

    def _data(self, path: str, broken: bool = False) -> DataFrame:
        """The rows of an attempt; with broken, without those of files that are missing or can't be read."""
        schema = StructType.fromJson(json.loads(self._files.read(f"{path}/SCHEMA")))
        reader = self.spark.read.schema(schema)
        if broken:
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return reader.parquet(f"{path}/data").drop(CHECK)

    def _summed(self, data: DataFrame, check: Column) -> DataFrame:
        return data.groupBy(MAP_ID, REDUCE_ID).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(check).alias("checksum"))

    def _lengths(self, data: DataFrame) -> DataFrame:
        """Rows and checksums by map and reduce partition, from the rows themselves."""
        columns = [c for c in data.columns if c not in (MAP_ID, REDUCE_ID)]
        return self._summed(data, row_checksum(columns) if columns else F.lit(0).cast("long"))

    def _sizes(self, path: str, start: int = 0, end: int = 1 << 31) -> dict[str, list[int]]:
        """Files and bytes of the partitions start to end - 1, by folder; of all data in the layout map. One call a folder, none a file."""
        folders = [x for x in self._files.list(f"{path}/data") if x.startswith(f"{REDUCE_ID}=")]
        if not folders:
            return {"": list(self._files.summary(f"{path}/data"))}
        return {x: list(self._files.summary(f"{path}/data/{x}")) for x in folders if start <= int(x.partition("=")[2]) < end}

    def _complete(self, path: str, start: int = 0, end: int = 1 << 31) -> bool:
        """Whether the files of the partitions start to end - 1 are there as they were written; looks at their number and bytes only."""
        text = self._files.read(f"{path}/FILES")
        if text is None:
            return False
        told = json.loads(text)
        if "" in told:
            return told == self._sizes(path)
        return {k: n for k, n in told.items() if start <= int(k.partition("=")[2]) < end} == self._sizes(path, start, end)

    def _agrees(self, path: str) -> bool:
        """Whether all rows are those that the manifest tells of; reads them."""
        if self._files.read(f"{path}/SCHEMA") is None or not self._files.exists(f"{path}/manifest"):
            return False
        told = self.spark.read.parquet(f"{path}/manifest")
        found = self._lengths(self._data(path)) if self._files.list(f"{path}/data") else told.limit(0)
        return told.exceptAll(found).isEmpty() and found.exceptAll(told).isEmpty()

    def commit(self, attempt: Attempt) -> bool:
        """Makes a valid attempt the one that counts; the one before stays for its readers until the next commit. An invalid attempt is deleted: where there is an older one that stays and the result is False, else CorruptExchange is raised."""
        self.invalidate(attempt.shuffle_id)
        old = self._pointer(attempt.shuffle_id)
        if old and old["attempt"] == attempt.uuid:
            return True
        if not self._complete(attempt.path):
            self.recall(attempt)
            if old:
                return False
            raise CorruptExchange(f"attempt {attempt.uuid} of exchange {attempt.shuffle_id} lacks files")
        pointer = {"attempt": attempt.uuid, "num_partitions": attempt.num_partitions, "dropped_maps": [], "before": old["attempt"] if old else None}
        self._files.replace(f"{self._shuffle(attempt.shuffle_id)}/CURRENT", json.dumps(pointer))
        self.invalidate(attempt.shuffle_id)
        if old and old.get("before"):
            self._files.delete(f"{self._shuffle(attempt.shuffle_id)}/attempt={old['before']}")
        return True

    def recall(self, attempt: Attempt) -> None:
        """Deletes an attempt that wasn't committed; repeating it is no error."""
        pointer = self._pointer(attempt.shuffle_id)
        if pointer and pointer["attempt"] == attempt.uuid:
            raise ValueError("the attempt is committed; drop the exchange instead")
        self._files.delete(attempt.path)

    def put(self, df: DataFrame, shuffle_id: int, spec: ExchangeSpec, map_id: Column | None = None, layout: str = "reduce") -> Attempt:
        attempt = self.write(df, shuffle_id, spec, map_id, layout)
        self.commit(attempt)
        return attempt

    # reading

    def _current(self, shuffle_id: int) -> tuple[str, dict]:
        pointer = self._pointer(shuffle_id)
        path = lambda: f"{self._shuffle(shuffle_id)}/attempt={pointer['attempt']}"
        if pointer is not None and not self._files.exists(path()):
            self.invalidate(shuffle_id)  # another session has committed since
            pointer = self._pointer(shuffle_id)
        if pointer is None:
            raise MissingExchange(shuffle_id)
        return path(), pointer

    def read(self, shuffle_id: int, start: int = 0, end: int | None = None, map_ids: list[int] | None = None, strict: bool = True) -> DataFrame:
        """Rows of the partitions start to end - 1, with map_id and reduce_id; only these partitions' folders are read.

        strict: files that are missing or have another size raise CorruptExchange (validate() reads the rows too); else partitions that don't agree with the manifest are left out (see skipped).
        """
        path, pointer = self._current(shuffle_id)
        end = pointer["num_partitions"] if end is None else end
        if strict and not self._complete(path, start, end):
            raise CorruptExchange(f"exchange {shuffle_id} lacks files, or has others than were written")
        data = self._data(path).where((F.col("reduce_id") >= start) & (F.col("reduce_id") < end))
        if pointer["dropped_maps"]:
            data = data.where(~F.col("map_id").isin(pointer["dropped_maps"]))
        if map_ids is not None:
            data = data.where(F.col("map_id").isin(map_ids))
        if not strict:
            # a row a partition of the range at most
            bad = [r.reduce_id for r in self.skipped(shuffle_id, start, end).select(REDUCE_ID).distinct().toLocalIterator()]
            data = self._data(path, broken=True).where((F.col(REDUCE_ID) >= start) & (F.col(REDUCE_ID) < end) & ~F.col(REDUCE_ID).isin(bad)) if bad else data
            for maps, wanted in ((pointer["dropped_maps"], False), (map_ids, True)):
                if bad and maps is not None:
                    data = data.where(F.col(MAP_ID).isin(maps) == wanted)
        return data

    def skipped(self, shuffle_id: int, start: int = 0, end: int = 1 << 31) -> DataFrame:
        """(map_id, reduce_id, told_rows, found_rows) where data and manifest disagree in the partitions start to end - 1: what read(strict=False) leaves out. Reads these partitions' rows."""
        path, pointer = self._current(shuffle_id)
        inside = (F.col(REDUCE_ID) >= start) & (F.col(REDUCE_ID) < end)
        told = self.manifest(shuffle_id).where(inside).select("map_id", "reduce_id", F.col("n_rows").alias("told_rows"), F.col("checksum").alias("a"))
        data = self._data(path, broken=True).where(inside)
        if pointer["dropped_maps"]:
            data = data.where(~F.col(MAP_ID).isin(pointer["dropped_maps"]))
        found = self._lengths(data).select("map_id", "reduce_id", F.col("n_rows").alias("found_rows"), F.col("checksum").alias("b"))
        return told.join(found, ["map_id", "reduce_id"], "full").where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("told_rows").eqNullSafe(F.col("found_rows"))).drop("a", "b")

    def manifest(self, shuffle_id: int) -> DataFrame:
        """(map_id, reduce_id, n_rows, checksum) of the partitions that have rows."""
        path, pointer = self._current(shuffle_id)
        told = self.spark.read.parquet(f"{path}/manifest")
        return told.where(~F.col("map_id").isin(pointer["dropped_maps"])) if pointer["dropped_maps"] else told

    def lengths(self, shuffle_id: int) -> DataFrame:
        """(reduce_id, n_rows) for every partition, the empty ones too."""
        _, pointer = self._current(shuffle_id)
        every = self.spark.range(pointer["num_partitions"]).select(F.col("id").cast("int").alias("reduce_id"))
        sums = self.manifest(shuffle_id).groupBy("reduce_id").agg(F.sum("n_rows").alias("n_rows"))
        return every.join(sums, "reduce_id", "left").select("reduce_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))

    def validate(self, shuffle_id: int) -> DataFrame | None:
        """lengths(); None if nothing is committed or there are no rows; CorruptExchange if the rows aren't those of the manifest. Reads all rows once."""
        if self._pointer(shuffle_id) is None:
            return None
        path, _ = self._current(shuffle_id)
        if not self._agrees(path):
            raise CorruptExchange(f"exchange {shuffle_id} doesn't agree with its manifest")
        return None if self.manifest(shuffle_id).isEmpty() else self.lengths(shuffle_id)

    def checksum(self, shuffle_id: int) -> DataFrame:
        """(reduce_id, n_rows, checksum): upper-case MD5 of each partition's row checksums, whatever the rows' order; combined on the map side."""
        sums = self.manifest(shuffle_id).groupBy("reduce_id").agg(F.sum("n_rows").alias("n_rows"), F.bit_xor("checksum").alias("x"))
        return sums.select("reduce_id", "n_rows", F.upper(F.md5(F.concat_ws(":", "n_rows", F.hex("x")).cast("binary"))).alias("checksum"))

    def dump(self, shuffle_id: int, reduce_id: int, target: str | None = None) -> str:
        """Copies a partition as it lies, agreeing or not, to a folder, over an older dump; returns the folder."""
        path, _ = self._current(shuffle_id)
        target = target or f"{self.root}/{self.app_id}/dump/shuffle_{shuffle_id}_{reduce_id}"
        self._data(path).where(F.col("reduce_id") == reduce_id).write.mode("overwrite").parquet(target)
        return target

    def dump_bytes(self, shuffle_id: int, reduce_id: int, target: str | None = None) -> str:
        """Copies a partition's files byte by byte, also such as can't be read, over an older dump; returns the folder. In the layout map, where partitions share files, all files are copied."""
        path, _ = self._current(shuffle_id)
        target = target or f"{self.root}/{self.app_id}/dump/shuffle_{shuffle_id}_{reduce_id}"
        own = f"{path}/data/{REDUCE_ID}={reduce_id}"
        source = own if self._files.exists(own) else f"{path}/data"
        if self._files.list(source):
            self._files.copy(source, target)
        return target

    def read_with(self, shuffle_id: int, action: Callable[[DataFrame], object], start: int = 0, end: int | None = None):
        """action(rows of the partitions start to end - 1), strictly read. Where that fails, partitions of the range whose data and manifest disagree are dumped as they lie, and the error is raised again, with a note that names the dumps."""
        try:
            return action(self.read(shuffle_id, start, end))
        except MissingExchange:
            raise
        except Exception as error:
            last = self._current(shuffle_id)[1]["num_partitions"] if end is None else end
            for r in self.skipped(shuffle_id, start, last).select(REDUCE_ID).distinct().orderBy(REDUCE_ID).toLocalIterator():
                error.add_note(f"dumped partition {r.reduce_id} to {self.dump_bytes(shuffle_id, r.reduce_id)}")
            raise

    # deleting

    def drop(self, shuffle_id: int) -> None:
        """Deletes an exchange with all its attempts; a missing one is no error."""
        self.invalidate(shuffle_id)
        self._files.delete(self._shuffle(shuffle_id))

    def drop_map(self, shuffle_id: int, map_id: int) -> None:
        """Takes a map's output out of an exchange, in all its partitions; repeating it is no error. Its rows go with the exchange."""
        _, pointer = self._current(shuffle_id)
        if map_id not in pointer["dropped_maps"]:
            self._files.replace(f"{self._shuffle(shuffle_id)}/CURRENT", json.dumps(pointer | {"dropped_maps": [*pointer["dropped_maps"], map_id]}))
            self.invalidate(shuffle_id)

    def counts(self) -> dict[str, int]:
        """committed: exchanges with a commit; temporary: attempts that don't count, but those that a commit has replaced and that wait for their readers."""
        out = {"committed": 0, "temporary": 0}
        for name in self._files.list(self.folder):
            shuffle_id = int(name.partition("=")[2])
            pointer = self._pointer(shuffle_id)
            attempts = [x for x in self._files.list(self._shuffle(shuffle_id)) if x.startswith("attempt=")]
            out["committed"] += pointer is not None
            out["temporary"] += sum(not pointer or x.partition("=")[2] not in (pointer["attempt"], pointer.get("before")) for x in attempts)
        return out

    def cleanup(self) -> None:
        """Deletes all that this application stored."""
        self.invalidate()
        self._files.delete(f"{self.root}/{self.app_id}")

    def close(self) -> None:
        if self.clear_on_close:
            self.cleanup()
        self.invalidate()
        for x in self.listeners:
            x.on_end(self.app_id)
