"""WARC 1.1 archives as a Spark data source in Python, for reading and writing.

Reading plans partitions of whole files, small ones together. Predicates on the record type and on header columns
are pushed down: of each record the headers are parsed first, and the payload of a record that they exclude is neither
decoded nor kept. Where payloads aren't wanted at all, a record is read to the end of its HTTP head, which tells the
payload's length. Plain files are passed over by seeking; of gzip files, with one member a record, only as much of a
member as is needed is inflated, and members written here name their length, so the rest is sought past.

Writing makes one file a task, in the folder given, through the file system that the path's scheme names.
The files of successful tasks are named in a manifest that the driver writes last, and a reader of that folder
reads these files only, so attempts that failed or were lost with their executor leave nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import named

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_bytes long, payload binary, file string, offset long"
#: Columns that headers give, and the headers.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
LEVEL, BATCH_BYTES = 4, 8 << 20
#: Bytes of files that a partition reads, but for single files that are larger; bytes that are read ahead.
PARTITION_BYTES, AHEAD = 16 << 20, 1 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header's value without characters that would end it: controls and blanks, which no URI holds as they are, become %XX."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, payload: bytes, target_uri: str | None = None, date: str | None = None, refers_to: str | None = None, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A record's bytes; without a date, of now. response: an HTTP response with the payload; revisit: its head only, with length and digest of the payload; else the payload itself."""
    http = kind in ("response", "revisit")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() if http else b""
    block = head if kind == "revisit" else head + payload
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{_field(record_id)}>", f"WARC-Date: {date or datetime.now(UTC).strftime('%Y-%m-%dT%H:%M:%SZ')}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_field(target_uri)}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <{_field(refers_to)}>")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    lines.append(f"Content-Type: {'application/http; msgtype=response' if http else content_type}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member whose extra field SL names the member's length."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HQ", 8, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Kept(WriterCommitMessage):
    file: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Columns record_type, record_id and payload, and target_uri, date, refers_to where they are there."""

    def __init__(self, path: str, compress: bool):
        self.path, self.compress = path, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' * self.compress}"
        pack = member if self.compress else bytes
        n = 0
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(pack(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", content_type="application/warc-fields")))
            for rows in iterator:
                names = rows.schema.names
                column = lambda c: rows.column(names.index(c)) if c in names else pa.nulls(rows.num_rows)  # noqa: B023, E731
                for kind, i, payload, uri, date, refers in zip(*map(column, ("record_type", "record_id", "payload", "target_uri", "date", "refers_to")), strict=True):
                    out.write(pack(record(kind.as_py(), i.as_py(), payload.as_py() or b"", uri.as_py(), date.as_py(), refers.as_py())))
                    n += 1
        return _Kept(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files = sorted(m.file for m in messages if m is not None)
        try:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = sorted({*files, *json.loads(f.read())})
        except FileNotFoundError:
            pass
        with where.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(files).encode())
        where.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{root}/{m.file}")


class _Source:
    """A file's bytes from a position on, through a window of it that is held."""

    def __init__(self, file, size: int, at: int = 0):
        self.file, self.size, self.at = file, size, at
        self.buffer, self.start = b"", at

    def need(self, n: int, ahead: int = 0) -> bytes:
        """n bytes from so far ahead of the position, or those that are left."""
        begin = self.at + ahead
        inside = begin - self.start
        if inside < 0 or inside + n > len(self.buffer) and self.start + len(self.buffer) < self.size:
            held = self.buffer[inside:] if 0 <= inside < len(self.buffer) else b""
            if begin + len(held) < self.size:
                self.file.seek(begin + len(held))
                held += self.file.read(max(n - len(held), AHEAD))
            self.buffer, self.start, inside = held, begin, 0
        return self.buffer[inside : inside + n]

    def skip(self, n: int) -> None:
        self.at += n


class _Plain:
    """Records of a file without compression."""

    def __init__(self, source: _Source):
        self.source = source

    def head(self) -> bytes | None:
        """The next record's headers; None at the end."""
        n = 1 << 12
        while True:
            data = self.source.need(n)
            if not data.strip():
                return None
            end = data.find(b"\r\n\r\n")
            if end >= 0:
                return data[:end]
            if len(data) < n:
                raise ValueError("headers don't end")
            n *= 2

    def block(self, head: int, length: int) -> bytes:
        data = self.source.need(length, head + 4)
        if len(data) < length:
            raise ValueError("the record is cut off")
        return data

    def begin(self, head: int, length: int, n: int) -> bytes:
        """The block's first n bytes, or all of it."""
        if self.source.at + head + 4 + length > self.source.size:
            raise ValueError("the record is cut off")
        return self.source.need(min(n, length), head + 4)

    def next(self, head: int, length: int) -> None:
        self.source.skip(head + 4 + length + 4)


class _Gzip:
    """Records of a file with one gzip member each."""

    def __init__(self, source: _Source):
        self.source = source

    def head(self) -> bytes | None:
        if not self.source.need(18):
            return None
        data = self.source.need(1 << 12)
        if data[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.length = None
        if data[3] == 4 and data[12:14] == b"SL" and struct.unpack("<H", data[14:16])[0] == 8:
            self.length = struct.unpack("<Q", data[16:24])[0]
        self.inflate = zlib.decompressobj(31)
        self.read, self.text = 0, b""
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self._more(1 << 13):
                raise ValueError("headers don't end")
        return self.text[:end]

    def _more(self, most: int) -> bool:
        """Inflates a little more; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail
        if not data:
            data = self.source.need(1 << 16, self.read)
            if not data:
                raise ValueError("the record is cut off")
            self.read += len(data)
        got = self.inflate.decompress(data, most)
        self.text += got
        return True

    def block(self, head: int, length: int) -> bytes:
        parts, have = [self.text], len(self.text)
        self.text = b""
        while have < head + 4 + length:
            if not self._more(1 << 20):
                raise ValueError("the record is cut off")
            parts.append(self.text)
            have += len(self.text)
            self.text = b""
        return b"".join(parts)[head + 4 : head + 4 + length]

    def begin(self, head: int, length: int, n: int) -> bytes:
        """The block's first n bytes, or all of it; no more is inflated than they need."""
        wanted = head + 4 + min(n, length)
        while len(self.text) < wanted:
            if not self._more(max(1 << 12, wanted - len(self.text))):
                raise ValueError("the record is cut off")
        return self.text[head + 4 : wanted]

    def next(self, head: int, length: int) -> None:
        if self.length is not None:
            self.source.skip(self.length)
            return
        while self._more(1 << 20):
            self.text = b""
        self.source.skip(self.read - len(self.inflate.unused_data))


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def payload_of(block: bytes, content_type: str | None) -> tuple[bytes, int]:
    """The payload that a block holds, and the length that the payload has by its HTTP head."""
    if not (content_type or "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return body, int(length[1]) if length else len(body)


def payload_length(records: _Plain | _Gzip, head: int, length: int, content_type: str | None) -> int:
    """The length that the payload has by its HTTP head, of which no more than that is read; without such a head the block's."""
    if not (content_type or "").startswith("application/http"):
        return length
    n = 1 << 10
    while True:
        begun = records.begin(head, length, n)
        end = begun.find(b"\r\n\r\n")
        if end >= 0 or len(begun) >= length:
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", begun[:end] if end >= 0 else begun)
            return int(said[1]) if said else length - end - 4 if end >= 0 else 0
        n *= 4


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = path
        self.with_payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.predicates: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes predicates on columns that headers give; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.predicates.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.predicates.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.predicates.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.predicates.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Files([(root, info.size)])]
        try:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                infos = where.get_file_info([f"{root}/{x}" for x in json.loads(f.read())])
        except FileNotFoundError:
            infos = [x for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        groups: list[list[tuple[str, int]]] = []
        held = 0
        for x in sorted(infos, key=lambda x: (-x.size, x.path)):
            if not groups or held + x.size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append((x.path, x.size))
            held += x.size
        return [_Files(g) for g in groups] or [_Files([])]

    def wanted(self, columns: dict[str, str | None]) -> bool:
        for column, how, value in self.predicates:
            got = columns[column]
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.files:
            yield from self._read(where, path, size)

    def _read(self, where: fs.FileSystem, path: str, size: int) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = [*HEADERS, "payload_bytes", "payload", "file", "offset"]
        out: list[list] = [[] for _ in names]
        held = 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
        with where.open_input_file(path) as f:
            source = _Source(f, size)
            records = _Gzip(source) if source.need(2)[:2] == b"\x1f\x8b" else _Plain(source)
            while True:
                at = source.at
                try:
                    head = records.head()
                    if head is None:
                        break
                    headers = parse_headers(head)
                    length = int(headers["content-length"])
                    columns = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                    for c in ("record_id", "refers_to"):
                        columns[c] = columns[c] and columns[c].strip("<>")
                    columns["payload_digest"] = columns["payload_digest"] and columns["payload_digest"].rpartition(":")[2]
                    if self.wanted(columns):
                        whole = columns["record_type"] != "revisit"
                        if self.with_payload or self.verify:
                            payload, n = payload_of(records.block(len(head), length), columns["content_type"])
                        else:
                            payload, n = b"", payload_length(records, len(head), length, columns["content_type"])
                        if self.verify and whole and (n != len(payload) or columns["payload_digest"] not in (None, digest(payload))):
                            raise ValueError("the payload doesn't have its digest or length")
                        for column, x in zip(out, (*columns.values(), n, payload if whole and self.with_payload else None, path, at), strict=True):
                            column.append(x)
                        held += len(payload) + 500
                    records.next(len(head), length)
                except (ValueError, KeyError, zlib.error) as error:
                    raise ValueError(f"{path}, record at {at}: {error}") from error
                if held > BATCH_BYTES:
                    yield made()
                    out = [[] for _ in names]
                    held = 0
        if out[0]:
            yield made()


class WarcDataSource(DataSource):
    """Format warc. Options: path; payload (true: decode it into the column); verify (false: hold payloads against their digests); compress (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], {k.lower(): v.lower() for k, v in self.options.items() if k.lower() != "path"})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("compress", "true").lower() == "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of a file, or of the files below a folder, as SCHEMA; payload is null for revisit records, payload_bytes is the length of the full payload."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """Adds records to the archives below path: columns record_type, record_id (neither null), payload (null: empty), and target_uri, date, refers_to if there."""
    spark = records.sparkSession
    spark.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)


def with_revisits(pages: DataFrame, id_col: str, payload: str, at_least: int = 0) -> DataFrame:
    """pages with record_type and refers_to: of rows with equal payloads (binary) of at least so many bytes, those with the largest id are response, the others revisit it; refers_to is its id.

    A null payload is empty. A null id is smaller than all others; rows that repeat the largest id are all response. Only payloads that occur again are joined back, by their SHA-256; a frequent payload's rows are not gathered in one task.
    """
    names = ("record_type", "refers_to", "__key", "__largest", "__n")
    data = F.coalesce(F.col(f"`{payload}`"), F.lit(b""))
    keyed = pages.select(*[named(c) for c in pages.columns if c not in names], F.when(F.octet_length(data) >= at_least, F.unhex(F.sha2(data, 256))).alias("__key"))
    again = keyed.where("__key is not null").groupBy("__key").agg(F.max(f"`{id_col}`").alias("__largest"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = keyed.join(again, "__key", "left")
    revisit = F.col("__n").isNotNull() & ~F.col(f"`{id_col}`").eqNullSafe(F.col("__largest"))
    return joined.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("__largest"))).drop("__key", "__largest", "__n")
