import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from shuffleframe.llm import queries
from shuffleframe.llm import warc as W

ROWS = [("response", "urn:a", "http://a/1", None, "é" * 5000), ("revisit", "urn:b", "http://a/2", "urn:a", "é" * 5000), ("response", "urn:c", None, None, None), ("resource", "urn:d", "http://b/\r\nx y", None, "WARC/1.1\r\n\r\n\r\n"), ("response", "urn:e", "http://b/2", None, "x" * 3_000_000)]


@pytest.fixture(params=[True, False])
def archive(spark, tmp_path, request):
    frame = spark.createDataFrame(ROWS, "record_type string, record_id string, target_uri string, refers_to string, payload string").withColumn("payload", F.encode("payload", "UTF-8"))
    W.write_warc(frame.repartition(2), f"file://{tmp_path}/x", compress=request.param)
    return f"file://{tmp_path}/x"


def test_round_trip(spark, archive):
    got = {r.record_id: r for r in W.read_warc(spark, archive, verify=True).where("record_type != 'warcinfo'").collect()}
    assert set(got) == {r[1] for r in ROWS}
    for kind, i, uri, refers, payload in ROWS:
        data = (payload or "").encode()
        r = got[i]
        assert (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) == (kind, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), refers)
        assert r.payload == (None if kind == "revisit" else data)
        assert r.target_uri == (uri and uri.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))


def test_predicates_are_pushed_down(spark, archive):
    found = W.read_warc(spark, archive).where("record_type = 'response' and target_uri like 'http://b%'")
    assert [r.record_id for r in found.collect()] == ["urn:e"]
    assert W.read_warc(spark, archive, payload=False).where("record_type in ('warcinfo', 'revisit') and target_uri is not null").count() == 1
    reader = W.WarcReader(archive, {})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 5)]))
    assert len(left) == 1 and len(reader.predicates) == 1
    blocks = []
    for cls in (W._Gzip, W._Plain):
        real = cls.block
        cls.block = lambda self, *a, real=real: blocks.append(a) or real(self, *a)
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == 3 and len(blocks) == 3  # no other record's block was decoded


def test_foreign_and_broken_archives(spark, tmp_path):
    records = [W.record("response", f"urn:{i}", b"p" * i) for i in range(40)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = W.read_warc(spark, f"file://{tmp_path}", verify=True).collect()
    assert sorted(r.payload_bytes for r in got) == sorted([*range(40), *range(40)])
    assert W.read_warc(spark, f"file://{tmp_path}").where("record_id = 'urn:7'").count() == 2
    (tmp_path / "b.warc").write_bytes(b"".join(records)[:-30])
    with pytest.raises(Exception, match="cut off"):
        W.read_warc(spark, f"file://{tmp_path}/b.warc").collect()
    (tmp_path / "b.warc").write_bytes(records[5].replace(b"ppppp", b"ppppq"))
    with pytest.raises(Exception, match="digest"):
        W.read_warc(spark, f"file://{tmp_path}/b.warc", verify=True).collect()


def test_files_without_manifest_entry_do_not_count(spark, archive):
    n = W.read_warc(spark, archive).count()
    with open(archive.removeprefix("file://") + "/part-lost.warc", "wb") as f:
        f.write(W.record("response", "urn:lost", b""))
    assert W.read_warc(spark, archive).count() == n


def test_with_revisits(spark):
    rows = [(1, b"a"), (2, b"a"), (3, b"b"), (None, b"a"), (4, None), (5, b""), (None, b"z"), (7, b"q"), (7, b"q"), (6, b"q")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, payload binary, record_type string")
    got = sorted((r.page_id or 0, bytes(r.payload or b""), r.record_type, r.refers_to) for r in W.with_revisits(frame, "page_id", "payload").collect())
    assert got == sorted([(1, b"a", "revisit", 2), (2, b"a", "response", None), (3, b"b", "response", None), (0, b"a", "revisit", 2), (4, b"", "revisit", 5), (5, b"", "response", None), (0, b"z", "response", None), (7, b"q", "response", None), (7, b"q", "response", None), (6, b"q", "revisit", 7)])
    assert W.with_revisits(frame.limit(0), "page_id", "payload").collect() == []
    assert {r.record_type for r in W.with_revisits(frame, "page_id", "payload", at_least=2).collect()} == {"response"}


def test_query_against_brute_force(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    largest = {}
    for i, p in pages:
        largest[p] = max(i, largest.get(p, i))
    want = sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if largest[p] == i else "revisit", None if largest[p] == i else largest[p]) for i, p in pages)
    assert sorted(map(tuple, queries.op4_warc(spark, "/root/testdata/sf0.01").collect())) == want


def test_payloads_that_are_not_wanted(spark, archive, monkeypatch):
    """Without payloads the same records, lengths and digests come, and no block is decoded whole."""
    full = {r.record_id: r for r in W.read_warc(spark, archive).collect()}
    short = {r.record_id: r for r in W.read_warc(spark, archive, payload=False).collect()}
    assert full.keys() == short.keys()
    for i, r in short.items():
        assert r.payload is None and (r.payload_bytes, r.payload_digest, r.record_type, r.offset) == (full[i].payload_bytes, full[i].payload_digest, full[i].record_type, full[i].offset)
    inflated = []
    for cls in (W._Gzip, W._Plain):
        monkeypatch.setattr(cls, "block", lambda self, *a: 1 / 0)
        monkeypatch.setattr(cls, "begin", lambda self, *a, real=cls.begin: inflated.append(len(x := real(self, *a))) or x)
    reader = W.WarcReader(archive, {"payload": "false"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(full)
    assert max(inflated) <= 1 << 10


def test_files_together_and_windows(spark, tmp_path, monkeypatch):
    records = [W.record(kind, f"urn:{i}", b"p" * (i * 37), content_type="text/plain") for i, kind in enumerate(["response", "resource", "revisit"] * 30)]
    for k in range(9):
        (tmp_path / f"{k}.warc").write_bytes(b"".join(records[k::9]))
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(map(W.member, records[k::9])))
    reader = W.WarcReader(f"file://{tmp_path}", {"payload": "false"})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(W, "PARTITION_BYTES", 20_000)
    assert 1 < len(reader.partitions()) < 18
    for ahead in (1, 100, 5000):
        monkeypatch.setattr(W, "AHEAD", ahead)
        for options in ({"payload": "false"}, {}):
            r = W.WarcReader(f"file://{tmp_path}", options)
            got = sorted((i, n) for p in r.partitions() for b in r.read(p) for i, n in zip(b.column(1).to_pylist(), b.column(7).to_pylist(), strict=True))
            assert got == sorted([(f"urn:{i}", i * 37) for i in range(90)] * 2)
