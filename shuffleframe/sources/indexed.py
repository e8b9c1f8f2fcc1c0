"""Reads and writes map outputs that lie as a data file with an index file beside it: shuffle_{s}_{m}_0.data and .index.

The index holds n + 1 running offsets, big-endian whole numbers of 64 bits; a missing index means one data file
for each reduce partition, shuffle_{s}_{m}_{r}.data. Files are listed and index files read by Spark's binaryFile source, and offsets
are decoded with column functions. Of a data file each task reads the ranges of the partitions wanted and no more, through
pyarrow's file systems (file, hdfs, s3, gs, abfs), so a data file may be larger than memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.manifest import encode_index
from ..storage import arrow_path


def _named(files: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("path", r"shuffle_(\d+)_(\d+)_(\d+)\.(data|index)$", i)
    return files.where(part(1) != "").select(part(1).cast("int").alias("shuffle_id"), part(2).cast("int").alias("map_id"), part(3).cast("int").alias("file_reduce_id"), part(4).alias("kind"), "path", "length", *[c for c in ("content",) if c in files.columns])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(shuffle_id, map_id, i, offset) of all index files in a folder; an empty file has no rows."""
    found = _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.index").load(folder)).where("length > 0")
    checked = found.withColumn("content", F.when(F.col("length") % 8 == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of offsets: "), "path")).cast("binary")))
    at = F.sequence(F.lit(0), (F.col("length") / 8).cast("int") - 1)
    word = lambda i: F.expr("content").substr(i * 8 + 1, F.lit(8))
    offsets = F.transform(at, lambda i: F.conv(F.hex(word(i)), 16, 10).cast("long"))
    return checked.select("shuffle_id", "map_id", F.posexplode(offsets).alias("i", "offset"))


def _ranges(content: bool):
    """Reads path, start and length of each row: its bytes' MD5 and, if wanted, the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1)
                path, start, length = (row.column(row.schema.get_field_index(c))[0].as_py() for c in ("path", "start", "length"))
                where, at = arrow_path(path)
                with where.open_input_file(at) as f:
                    f.seek(start)
                    data = f.read(length)
                made = [pa.array([hashlib.md5(data).hexdigest().upper()]), *[pa.array([data], pa.binary())] * content]
                yield pa.RecordBatch.from_arrays([*row.columns, *made], names=[*row.schema.names, "md5", *["content"] * content])

    return run


def read_partitions(spark: SparkSession, folder: str, start: int = 0, end: int = 1 << 30, content: bool = True) -> DataFrame:
    """(shuffle_id, map_id, reduce_id, start, length, md5, valid[, content]) for the partitions start to end - 1 with bytes.

    valid: the index begins at 0 and ends at its data file's size; partitions without an index are valid. md5: upper-case, of the partition's bytes. A range that its file doesn't hold gives the bytes that are there.
    """
    data = _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.data").load(folder).drop("content")).drop("kind").withColumnRenamed("length", "data_size")
    by = W.partitionBy("shuffle_id", "map_id")
    index = read_index(spark, folder)
    ranges = index.select("shuffle_id", "map_id", F.col("i").alias("reduce_id"), F.col("offset").alias("start"), (F.lead("offset").over(by.orderBy("i")) - F.col("offset")).alias("length"), F.max("offset").over(by).alias("last"), F.min("offset").over(by).alias("first")).where("length is not null")
    sorted_ = data.where("file_reduce_id = 0").join(ranges, ["shuffle_id", "map_id"]).withColumn("valid", (F.col("first") == 0) & (F.col("last") == F.col("data_size"))).drop("file_reduce_id", "first", "last")
    hashed = data.join(index.select("shuffle_id", "map_id").distinct(), ["shuffle_id", "map_id"], "left_anti").select("shuffle_id", "map_id", "data_size", "path", F.col("file_reduce_id").alias("reduce_id"), F.lit(0).cast("long").alias("start"), F.col("data_size").alias("length"), F.lit(True).alias("valid"))
    names = ["shuffle_id", "map_id", "reduce_id", "start", "length", "valid", "path"]
    wanted = sorted_.select(*names).unionByName(hashed.select(*names)).where((F.col("reduce_id") >= start) & (F.col("reduce_id") < end) & (F.col("length") > 0))
    got = wanted.mapInArrow(_ranges(content), "shuffle_id int, map_id int, reduce_id int, start long, length long, valid boolean, path string, md5 string" + ", content binary" * content)
    return got.select("shuffle_id", "map_id", "reduce_id", "start", "length", "md5", "valid", *["content"] * content)


def write_maps(rows: DataFrame, folder: str, shuffle_id: int, num_partitions: int) -> DataFrame:
    """Writes rows (map_id, reduce_id, content) as a data file and an index file for each map; returns (map_id, bytes) of the maps written.

    A map is written by one task, as it would write its own output; rows of a map and partition are written one after the other in no defined order, partitions without rows are empty. Files are written under other names and moved to theirs when they are whole, the index last, so a task that is repeated replaces what it had left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = arrow_path(folder)
        where.create_dir(root, recursive=True)
        out, current, lengths, name = None, None, [0] * num_partitions, ""

        def done() -> pa.RecordBatch:
            out.close()
            base = f"{root}/shuffle_{shuffle_id}_{current}_0"
            with where.open_output_stream(f"{name}.index", compression=None) as f:
                f.write(encode_index(lengths))
            where.move(f"{name}.data", f"{base}.data")
            where.move(f"{name}.index", f"{base}.index")
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([sum(lengths)], pa.int64())], names=["map_id", "bytes"])

        for got in batches:
            for m, r, content in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2), strict=True):
                if m != current:
                    if out is not None:
                        yield done()
                    current, lengths, name = m, [0] * num_partitions, f"{root}/.{uuid.uuid4().hex}"
                    out = where.open_output_stream(f"{name}.data", compression=None)
                data = content.as_py() or b""
                out.write(data)
                lengths[r] += len(data)
        if out is not None:
            yield done()

    dealt = rows.select(F.col("map_id").cast("int"), F.col("reduce_id").cast("int"), F.col("content").cast("binary")).repartition("map_id").sortWithinPartitions("map_id", "reduce_id")
    return dealt.mapInArrow(run, "map_id int, bytes long")
