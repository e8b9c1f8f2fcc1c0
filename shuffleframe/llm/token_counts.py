"""Document token counts of flat token files that have no index, by a separator scan.

A file is a run of little-endian ids in which an end-of-document id follows each document. Files are cut into
blocks of a fixed size wherever that falls. Each block is searched for separators at once (a vector
comparison); it gives the distances between them and its last separator's position. A prefix scan over the
blocks, within groups of blocks first and then over the groups, gives each block the number of separators
before it and the position after the last of them, which stitches the documents that lie across blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialise

BLOCK_BYTES = 8 << 20
#: White space characters in a row from which on a run is taken out of a text before it is encoded; this changes no id.
LONG_RUN = 4096
#: The characters that Unicode counts as white space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Blocks of a group of the prefix scan.
GROUP = 1024


def by_runs(encode: Callable[[str], list[int]], encode_run: Callable[[str], list[int]], longest: int = LONG_RUN) -> Callable[[str], list[int]]:
    """encode for texts with runs of white space of any length, on which a byte-level encoder's pattern runs out of stack.

    The pattern takes such a run as one unit, but for its last character if anything follows, which belongs to what follows. So a run of longest characters or more is encoded by encode_run, as one unit, and the text before it and from its last character on by encode: the same ids as of the whole.
    """
    runs = re.compile(f"[{_WHITE}]{{{max(2, longest)},}}")

    def whole(text: str) -> list[int]:
        at, out = 0, []
        for run in runs.finditer(text):
            to = run.end() - (run.end() < len(text))
            out += encode(text[at : run.start()])
            out += encode_run(text[run.start() : to])
            at = to
        return out + encode(text[at:]) if at else encode(text)

    return whole


def token_files(spark: SparkSession, path: str, suffix: str = ".bin") -> DataFrame:
    """(file, bytes) of the token files below a folder, or of one file. Listed by the driver, a row a file."""
    where, root = fs.FileSystem.from_uri(path)
    info = where.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(suffix)]
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return spark.createDataFrame([(scheme + x.path, x.size) for x in found], "file string, bytes long")


def write_token_files(docs: DataFrame, path: str, encode: Callable[[], Callable[[str], list[int]]], eod: int, dtype: str = "<u2", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a token file a task and returns (id, file, ordinal, bytes): where each row's document stands. Null and empty texts have no tokens; repeated rows are documents of their own; rows with a null id are written as well; no rows give no rows. Other columns aren't read.

    encode() is called once a task and gives the function that encodes a text. The rows returned are those of successful tasks, so files of other attempts count for nothing.
    """
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        to_ids = encode()
        name = f"part-{uuid.uuid4().hex}.bin"
        ids, size = [], 0
        end = np.array([eod], dtype).tobytes()
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for rows in batches:
                ids.append(rows.column(0))
                for value in rows.column(1):
                    tokens = np.array(to_ids(value.as_py() or ""), np.int64)
                    if len(tokens) and ((tokens == eod).any() or tokens.min() < 0 or tokens.max() > np.iinfo(dtype).max):
                        raise ValueError("an id doesn't fit the files' type, or is the separator")
                    data = tokens.astype(dtype).tobytes() + end
                    out.write(data)
                    size += len(data)
        at = 0
        for column in ids:
            n = len(column)
            yield pa.RecordBatch.from_arrays([column, pa.array([f"{path}/{name}"] * n), pa.array(np.arange(at, at + n)), pa.array(np.full(n, size, np.int64))], names=["id", "file", "ordinal", "bytes"])
            at += n

    return materialise(arrow_map(frame, run, f"id {frame.schema['id'].dataType.simpleString()}, file string, ordinal long, bytes long"))


def _scan(eod: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for file, block, start, length in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                where, path = fs.FileSystem.from_uri(file)
                with where.open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(length)
                if len(data) != length:
                    raise ValueError(f"{file} is shorter than planned")
                tokens = np.frombuffer(data, dtype)
                ends = np.flatnonzero(tokens == eod)
                first = start // tokens.itemsize
                lengths = np.diff(ends, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block]),
                        pa.array([first]),
                        pa.array([len(tokens)]),
                        pa.array([len(ends)]),
                        pa.array([first + int(ends[-1]) + 1 if len(ends) else None], pa.int64()),
                        pa.array([lengths], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "first", "tokens", "ends", "after", "lengths"],
                )

    return run


def token_counts(files: DataFrame, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """(file, ordinal, n_tokens) for each document of the token files (file, bytes): its number in the file and its tokens without the separator.

    Two separators in a row hold a document without tokens. Tokens after a file's last separator are a document; a file without bytes has none. A file whose bytes are no whole number of ids fails. Files named twice count once. Blocks are read from the files' store by whichever task gets them.
    """
    size = np.dtype(dtype).itemsize
    block = max(1, block_bytes // size) * size
    known = files.groupBy("file").agg(F.max("bytes").alias("bytes")).where("bytes > 0")
    known = known.withColumn("bytes", F.when(F.col("bytes") % size == 0, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("file"))).cast("long")))
    last_block = F.floor((F.col("bytes") - 1) / block).cast("long")
    blocks = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block))).withColumn("start", F.col("block") * block)
    blocks = blocks.select("file", "block", "start", F.least(F.lit(block).cast("long"), F.col("bytes") - F.col("start")).alias("length"))
    spread = blocks.repartition(F.xxhash64("file", "block"))
    scanned = materialise(arrow_map(spread, _scan(eod, dtype), "file string, block long, first long, tokens long, ends long, after long, lengths array<long>"))

    # the prefix scan: over the blocks of a group, then over the groups of a file
    slim = scanned.select("file", "block", F.floor(F.col("block") / group).alias("part"), "ends", "after")
    parts = slim.groupBy("file", "part").agg(F.sum("ends").alias("ends"), F.max("after").alias("after"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    over_parts = before(W.partitionBy("file").orderBy("part"))
    carried = parts.select("file", "part", F.coalesce(F.sum("ends").over(over_parts), F.lit(0)).alias("part_ends"), F.coalesce(F.max("after").over(over_parts), F.lit(0)).alias("part_after"))
    over_blocks = before(W.partitionBy("file", "part").orderBy("block"))
    inside = slim.select("file", "part", "block", F.coalesce(F.sum("ends").over(over_blocks), F.lit(0)).alias("ends_before"), F.max("after").over(over_blocks).alias("after_before"))
    offsets = inside.join(carried, ["file", "part"]).select("file", "block", (F.col("part_ends") + F.col("ends_before")).alias("ordinal"), F.greatest("part_after", F.coalesce("after_before", F.lit(0))).alias("begins"))

    # begins: where the document that the block's first separator ends has begun
    found = scanned.join(offsets, ["file", "block"])
    whole = found.select("file", "first", "begins", "ordinal", F.posexplode("lengths").alias("k", "length"))
    stitched = F.when(F.col("k") == 0, F.col("first") - F.col("begins") + F.col("length")).otherwise(F.col("length"))
    documents = whole.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), stitched.alias("n_tokens"))
    tails = scanned.groupBy("file").agg(F.max(F.col("first") + F.col("tokens")).alias("end"), F.sum("ends").alias("ordinal"), F.coalesce(F.max("after"), F.lit(0)).alias("after")).where("end > after")
    return documents.unionByName(tails.select("file", "ordinal", (F.col("end") - F.col("after")).alias("n_tokens")))
