import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shuffleframe.llm import queries
from shuffleframe.llm import token_counts as T


def plain(tokens, eod):
    out, n = [], 0
    for t in tokens:
        if t == eod:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


@pytest.mark.parametrize("block,group", [(2, 2), (14, 3), (64, 1), (1 << 20, 1024)])
def test_files_and_blocks(spark, tmp_path, block, group):
    rng = np.random.default_rng(block)
    want = {}
    files = [[], [9], [9, 9, 1], [1, 2, 3], [1] * 90 + [9] + [2] * 5, [9] * 30] + [np.where(rng.random(70) < 0.1, 9, 3).tolist() for _ in range(3)]
    for i, tokens in enumerate(files):
        (tmp_path / f"{i}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
        want |= {(f"{i}.bin", k): n for k, n in enumerate(plain(tokens, 9))}
    listed = T.token_files(spark, f"file://{tmp_path}")
    got = T.token_counts(listed.unionByName(listed), 9, block_bytes=block, group=group).collect()
    assert len(got) == len(want)
    assert {(r.file.rpartition("/")[2], r.ordinal): r.n_tokens for r in got} == want


def test_wide_ids_and_broken_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([70_000, 1, 2, 70_000], "<u4").tobytes())
    files = T.token_files(spark, f"file://{tmp_path}/a.bin")
    assert sorted(r.n_tokens for r in T.token_counts(files, 70_000, "<u4").collect()) == [0, 2]
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        T.token_counts(T.token_files(spark, f"file://{tmp_path}/a.bin"), 1).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 9))
def test_scan_of_blocks_adds_up(tokens, width):
    """The stitching in plain Python over the same block results."""
    a = np.array(tokens, "<u2")
    out, ordinal, begins = [], 0, 0
    for first in range(0, len(a), width):
        ends = np.flatnonzero(a[first : first + width] == 0)
        for k, n in enumerate(np.diff(ends, prepend=-1) - 1):
            out.append(int(first - begins + n if k == 0 else n))
        ordinal += len(ends)
        begins = first + int(ends[-1]) + 1 if len(ends) else begins
    assert out + [len(a) - begins] * (len(a) > begins) == plain(tokens, 0)


def test_written_documents(spark, tmp_path):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 100_000), (1, "Hello world"), (5, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, file string, ordinal int")
    written = T.write_token_files(docs.repartition(3), f"file://{tmp_path}/t", queries.byte_encoder, queries.END_OF_DOCUMENT)
    got = written.join(T.token_counts(written, queries.END_OF_DOCUMENT, block_bytes=1000), ["file", "ordinal"]).collect()
    encode = queries.byte_encoder()
    assert sorted((r.id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(encode(t or ""))) for i, t in rows)
    none = T.write_token_files(docs.limit(0), f"file://{tmp_path}/u", queries.byte_encoder, queries.END_OF_DOCUMENT)
    assert T.token_counts(none, queries.END_OF_DOCUMENT).collect() == []


def test_query_against_brute_force(spark):
    encode = queries.byte_encoder()
    want = sorted((r.doc_id, len(encode(r.text or ""))) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert sorted(map(tuple, queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect())) == want


def test_long_runs(spark, tmp_path):
    """Runs of white space longer than an encoder's stack can take, and other long runs."""
    encode = queries.byte_encoder()
    assert len(encode(" " * 1_000_000)) > 0 and len(encode("a" + "\n" * 1_000_000 + "b")) > 0 and len(encode("x" * 10_000_000)) > 0
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "word" + "\t " * 500_000 + " word"), (4, "\u3000" * 300_000 + "x")]
    written = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", queries.byte_encoder, queries.END_OF_DOCUMENT)
    got = written.join(T.token_counts(written, queries.END_OF_DOCUMENT), ["file", "ordinal"]).collect()
    assert {r.id: r.n_tokens for r in got} == {i: len(encode(t)) for i, t in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t\u2003\x85\x1cab1!'é", max_size=40), st.integers(2, 5))
def test_runs_change_no_id(text, longest):
    plain, one = _encoders()
    assert T.by_runs(plain, one, longest)(text) == plain(text)


def _encoders(made=[]):  # noqa: B006
    if not made:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        made += [tiktoken.Encoding("t", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (public_tokenizers.PATTERN, r"[\s\S]+")]
    return made
