"""Folders and small files in the store that all executors share.

Backend is what a store needs of a file system on the driver's side. Files is the one over Spark's Hadoop file systems,
ArrowFiles another over pyarrow's; register_backend() adds more.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session in one process gets a temporary one, which is set; on a cluster it is an error, as no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='shuffleframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, prefix: str = "run") -> str:
    """A folder's name below the shared root, new with every call; release() deletes it."""
    _made.append(path := f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}")
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later plans neither recompute it nor depend on its lineage."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that new_folder() has named in this process.
_made: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes what new_folder() and materialise() have named, once no result is read from it any more; returns how many folders there were."""
    n = len(_made)
    while _made:
        path = _made.pop()
        Files(spark, path).delete(path)
    return n


class Backend(ABC):
    """A file system as the driver sees it: small files, folders, and bounded reads. Paths are those that Spark reads and writes."""

    @abstractmethod
    def exists(self, path: str) -> bool: ...

    @abstractmethod
    def delete(self, path: str) -> None:
        """Deletes a file or folder; a missing one is no error."""

    @abstractmethod
    def list(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""

    @abstractmethod
    def summary(self, path: str) -> tuple[int, int]:
        """How many files lie below a folder, and their bytes; (0, 0) if it is missing."""

    @abstractmethod
    def read_range(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a file from start on, length at most; no more are read. A range beyond the end is cut, a missing file is FileNotFoundError."""

    @abstractmethod
    def replace(self, path: str, text: str) -> None:
        """Writes a small file beside its place and moves it over what is there, in one step where the store can."""

    @abstractmethod
    def copy(self, source: str, target: str) -> None:
        """Copies a file or folder byte by byte, over an older copy."""

    def read(self, path: str) -> str | None:
        """A small file's text; None if it is missing."""
        return self.read_range(path).decode() if self.exists(path) else None


class Files(Backend):
    """Through Hadoop's file systems, so in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(root).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def list(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def summary(self, path: str) -> tuple[int, int]:
        if not self.exists(path):
            return 0, 0
        found = self._fs.getContentSummary(self._path(path))
        return found.getFileCount(), found.getLength()

    def read_range(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        if not self.exists(path):
            raise FileNotFoundError(path)
        left = max(0, self._fs.getFileStatus(self._path(path)).getLen() - start)
        stream = self._fs.open(self._path(path))
        try:
            stream.seek(start if left else 0)
            return bytes(stream.readNBytes(min(left, left if length is None else max(length, 0))))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        new = f"{path}.{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(self._path(new)), self._fs.makeQualified(self._path(path)), options)

    def copy(self, source: str, target: str) -> None:
        self.delete(target)
        self._fs.setVerifyChecksum(False)  # bytes as they lie, damaged or not
        try:
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(source), self._fs, self._path(target), False, True, self._conf)
        finally:
            self._fs.setVerifyChecksum(True)


def arrow_path(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path for a path as Spark names it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


class ArrowFiles(Backend):
    """Through pyarrow's file systems: file, hdfs, s3, gs, abfs."""

    def __init__(self, spark: SparkSession, root: str):
        self._fs, _ = arrow_path(root)
        self._in = lambda p: arrow_path(p)[1]

    def _kind(self, path: str) -> fs.FileType:
        return self._fs.get_file_info(self._in(path)).type

    def exists(self, path: str) -> bool:
        return self._kind(path) != fs.FileType.NotFound

    def delete(self, path: str) -> None:
        kind = self._kind(path)
        if kind == fs.FileType.Directory:
            self._fs.delete_dir(self._in(path))
        elif kind == fs.FileType.File:
            self._fs.delete_file(self._in(path))

    def list(self, path: str) -> list[str]:
        return sorted(x.base_name for x in self._fs.get_file_info(fs.FileSelector(self._in(path), allow_not_found=True)))

    def summary(self, path: str) -> tuple[int, int]:
        files = [x for x in self._fs.get_file_info(fs.FileSelector(self._in(path), allow_not_found=True, recursive=True)) if x.type == fs.FileType.File and not re.search(r"/\.[^/]*\.crc$", x.path)]
        return len(files), sum(x.size for x in files)

    def read_range(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        with self._fs.open_input_file(self._in(path)) as f:
            left = max(0, f.size() - start)
            f.seek(start if left else 0)
            return f.read(min(left, left if length is None else max(length, 0)))

    def replace(self, path: str, text: str) -> None:
        new = f"{self._in(path)}.{uuid.uuid4().hex}.new"
        self._fs.create_dir(new.rpartition("/")[0], recursive=True)
        with self._fs.open_output_stream(new, compression=None) as f:
            f.write(text.encode())
        self._fs.move(new, self._in(path))

    def copy(self, source: str, target: str) -> None:
        self.delete(target)
        if self._kind(source) == fs.FileType.File:
            self._fs.create_dir(self._in(target).rpartition("/")[0], recursive=True)
            self._fs.copy_file(self._in(source), self._in(target))
        else:
            self._fs.create_dir(self._in(target), recursive=True)
            fs.copy_files(self._in(source), self._in(target), source_filesystem=self._fs, destination_filesystem=self._fs)


#: Backends by name: what gives the driver's view of a root folder.
BACKENDS: dict[str, Callable[[SparkSession, str], Backend]] = {"fs": Files, "arrow": ArrowFiles}


def register_backend(name: str, factory: Callable[[SparkSession, str], Backend]) -> None:
    """Makes a backend known by name; factory(spark, root) gives a Backend. A name that is taken is an error."""
    if name in BACKENDS:
        raise ValueError(f"there is a backend {name!r} already")
    BACKENDS[name] = factory
