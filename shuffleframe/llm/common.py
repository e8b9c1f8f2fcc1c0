"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (see shared_root for where that is unset)."""
    _made.append(path := f"{shared_root(spark)}/llm-{uuid.uuid4().hex}")
    return path


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


#: The one column that operators carry a caller's columns in, so that no name of theirs can clash with an operator's own.
KEPT = "kept"


def packed(columns: list[str]) -> Column:
    """A struct of these columns, to be carried as KEPT."""
    return F.struct(*[named(c).alias(str(i)) for i, c in enumerate(columns)] or [F.lit(None).cast("int").alias("none")]).alias(KEPT)


def unpacked(columns: list[str]) -> list[Column]:
    """The columns packed into KEPT, under their names."""
    return [F.col(KEPT).getField(str(i)).alias(c) for i, c in enumerate(columns)]


#: Folders that this process has named in the shared folder.
_made: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the folders that operators have written below spark.checkpoint.dir, once their results are no longer needed; returns how many there were."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends and survives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, kept: list[str], text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """(KEPT and the text, what gives a batch's texts): a text that is among the columns kept is sent once."""
    if text in kept:
        at = kept.index(text)
        return docs.select(packed(kept)), lambda rows: rows.column(0).field(at)
    return docs.select(packed(kept), named(text).alias("text")), lambda rows: rows.column(1)


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the id's decimal text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


#: Bytes of a batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes, as rows may be long texts; a smaller bound of the session's stays."""
    conf = df.sparkSession.conf
    if not 0 < int(re.sub(r"[^-\d]", "", conf.get(_BATCH_CONF))) <= BATCH_BYTES:
        conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's free memory to the system: Spark keeps workers for later tasks, beside the heap of the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for the nodes of the links a-b, without those that are smallest themselves."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(ids))
    while True:
        before = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        while not np.array_equal(low, jumped := low[low]):
            low = jumped
        if np.array_equal(low, before):
            break
    rest = low != np.arange(len(ids))
    return ids[rest], ids[low[rest]]


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a whole text in UTF-8, A-Z in lower case, in blocks of about size bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, n = 0, len(data)
    while at < n:
        to = n
        if n - at > size and (blank := _BLANK.search(data, at + size)):
            to = blank.start()
        if words := data[at:to].split():
            yield words
        at = to


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least so many rows (but the last) that split no group of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in batches:
        if not part.num_rows:
            continue
        held.append(part)
        rows += part.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for k in keys:
            column = whole.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(rows - np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            rows -= cut
        else:
            least = 2 * rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's group, of columns that are sorted."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def same_group_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, in blocks of pairs that are equally far apart."""
    at, d, n = np.arange(len(group)), 0, len(group)
    while True:
        d += 1
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return
        yield at, at + d


def promising(row: str, words: list[str], apart: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The values of row, a long, that have another of their group (key, low, high) whose words of bits differ from theirs in no more than apart bits; no pairs are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, ["key", "low", "high"]):
            key, low, high, own, number = (rows.column(c).to_numpy() for c in ("key", "low", "high", "own", row))
            bits = [rows.column(c).to_numpy().view(np.uint64) for c in words]  # signed numbers would be counted by their absolute value
            meets = np.zeros(len(key), bool)
            for x, y in same_group_pairs(group_numbers(key, low, high)):
                near = (sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in bits) <= apart) & ((low[x] == high[x]) | (own[x] != own[y]))
                meets[x[near]] = True
                meets[y[near]] = True
            if meets.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(number[meets]))], names=[row])

    return run


def in_chunks(keyed: DataFrame, keys: list[str], chunk: int, spread: str, differing: str | None = None) -> DataFrame:
    """The rows of keyed, dealt so that no group exceeds 2 * chunk rows and any two rows with equal keys meet in just one group.

    Adds the columns own, low and high: a key of n > chunk rows falls into ceil(n / chunk) chunks by a hash of the column spread, own; a row goes to the groups (keys, low, high) of its chunk with each chunk. Rows of different chunks are to be compared where low < high, those of one chunk where low = high. Rows of other keys stay as they are, in a group of their key.
    keyed must be cheap to compute twice or materialised. Only the frequent keys are joined back, and no key is gathered in one task. differing: a column; rows whose key has only one value of it, and so no partner with another, are left out, and all other keys are joined back.
    """
    wanted = F.min(differing) != F.max(differing) if differing else F.count(F.lit(1)) > chunk
    frequent = materialise(keyed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__chunks"), wanted.alias("__wanted")).where("__wanted").drop("__wanted"))
    joined = keyed.join(frequent, keys, "inner" if differing else "left")
    many = F.coalesce(F.col("__chunks"), F.lit(1)) > 1
    own = F.when(many, F.pmod(F.xxhash64(F.lit("chunk"), F.col(spread)), F.col("__chunks").cast("long")).cast("int")).otherwise(F.lit(0))
    others = F.when(many, F.sequence(F.lit(0), F.col("__chunks") - 1)).otherwise(F.array(F.lit(0)))
    return joined.withColumn("own", own).withColumn("__other", F.explode(others)).withColumn("low", F.least("own", "__other")).withColumn("high", F.greatest("own", "__other")).drop("__other", "__chunks")
