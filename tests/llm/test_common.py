import glob

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shuffleframe.llm import common as C


@settings(deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9), st.integers(1, 20))
def test_complete_groups(keys, size, least):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], names=["k"]) for i in range(0, len(keys), size)]
    tables = [t.column("k").to_pylist() for t in C.complete_groups(iter(batches), ["k"], least)]
    assert [k for t in tables for k in t] == keys
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_spanning_forest(links):
    a, b = np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)
    low = {n: n for p in links for n in p}
    for _ in range(40):
        for x, y in links:
            low[x] = low[y] = min(low[x], low[y])
    u, v = C.spanning_forest(a, b)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {n: m for n, m in low.items() if n != m}


@settings(deadline=None)
@given(st.text(alphabet="aB \n\té", max_size=200), st.integers(1, 50))
def test_word_blocks(text, size):
    assert [w for block in C.word_blocks(text, size) for w in block] == text.encode().lower().split()


def test_release(spark):
    C.release(spark)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/llm-*"))
    C.materialise(spark.range(3))
    assert len(set(glob.glob(f"{root}/llm-*")) - before) == 1
    assert C.release(spark) == 1 and C.release(spark) == 0
    assert set(glob.glob(f"{root}/llm-*")) == before
