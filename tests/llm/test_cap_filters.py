import itertools
import math
import random

import numpy as np
import pytest

from shuffleframe.llm import cap_filters as C
from shuffleframe.llm import queries

from .test_simhash import components


def test_decode_finds_all_filters_above_the_height():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = C.Codes.make(30, blocks=3, words=5, height=1.5, least=4)
    names = list(itertools.product(range(5), repeat=3))
    directions = np.array([np.concatenate([codes.words[j, k] for j, k in enumerate(name)]) for name in names])
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    scores = x @ codes.rotation @ directions.T
    for got, s in zip(codes.decode(x), scores, strict=True):
        above = set(np.flatnonzero(s >= codes.height).tolist())
        if len(above) >= 4:
            assert set(got.tolist()) == above
        else:
            assert len(got) >= 4 and set(got.tolist()) == set(np.argsort(-s)[: len(got)].tolist())


def plain(rows, threshold=0.98):
    """(n_links by row, links of ids) by brute force."""
    unit = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v))) if ok else None)
    n, links = [0] * len(rows), []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            n[a] += 1
            n[b] += 1
            links.append((rows[a][0], rows[b][0]))
    return n, links


@pytest.mark.parametrize("chunk", [7, 512])
def test_against_brute_force(spark, chunk):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.standard_normal(64) * 0.1).tolist(), int(rng.integers(0, 2))))
    hot = rng.standard_normal(64)
    rows += [(1000 + i, (hot + rng.standard_normal(64) * 0.03).tolist(), 1) for i in range(90)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [nan] * 64, 1), (2003, [inf] * 64, 1), (2004, [None] * 64, 1), (2005, [], 1), (2006, rows[0][1], None), (None, rows[0][1], 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1e200] * 64, 1), (2010, [1e-200] * 64, 1)]
    rows += [rows[0], rows[1]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = C.near_duplicates(frame, chunk=chunk).collect()
    n, links = plain(rows)
    low = components([i for i, _, _ in rows if i is not None], links)
    want = sorted((i is None, i or 0, k, low.get(i), None if i is None else low[i] == i) for (i, _, _), k in zip(rows, n, strict=True))
    assert sorted((r.id is None, r.id or 0, r.n_links, r.component, r.kept) for r in got) == want
    assert C.near_duplicates(frame.limit(0)).collect() == []


def test_floats(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(16) * 0.05 + (i % 5 == np.arange(16))).astype(np.float32).tolist(), 0) for i in range(60)] + [(100, [1e38] * 16, 0), (101, [1e-40] * 16, 0)]
    got = sorted((r.id, r.n_links) for r in C.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")).collect())
    assert got == [(i, n) for (i, _, _), n in zip(rows, plain(rows)[0], strict=True)]


def test_recall_on_the_table(spark):
    got = {r.vec_id: r for r in queries.op3_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    n, links = plain(rows)
    low = components([i for i, _, _ in rows], links)
    assert sum(got[i].n_links for i, _, _ in rows) >= 0.98 * sum(n)
    assert all(got[i].n_links <= k for (i, _, _), k in zip(rows, n, strict=True))
    assert sum(got[i].component_id == low[i] for i, _, _ in rows) >= 0.99 * len(rows)
    assert random.Random(0)


def test_copies_are_one_vector(spark):
    """Thousands of copies, of several ids, labels and a neighbour, are counted in full."""
    rng = np.random.default_rng(7)
    hot = rng.standard_normal(32)
    near = (hot + rng.standard_normal(32) * 0.01).tolist()
    rows = [(i, hot.tolist(), i % 2) for i in range(6000)] + [(6000, near, 1), (6001, near, 0), (6002, near, None), (6002, rng.standard_normal(32).tolist(), 1)]
    got = {(r.id, r.n_links, r.component) for r in C.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)).collect()}
    assert got == {(i, 3000, i % 2) for i in range(6000)} | {(6000, 3000, 1), (6001, 3000, 0), (6002, 0, 6002)}


@pytest.mark.parametrize("rows", [1, C.SERVED, C.SERVED + 1, C.SERVED << 8])
def test_code_size_keeps_recall(rows):
    """At the threshold itself, with the codes of a label of so many rows."""
    words, height, least = C.code_size(rows)
    assert words == (16 if rows <= C.SERVED else 32 if rows <= C.SERVED << 4 else 64)
    codes, rng = C.Codes.make(64, words=words, height=height, least=least), np.random.default_rng(8)
    x, z = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    pairs = list(zip(codes.decode(x), codes.decode(y), strict=True))
    assert sum(len(np.intersect1d(a, b)) > 0 for a, b in pairs) >= 995
    assert sum(len(np.intersect1d(a, b)) > 0 for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False)) <= 20


def test_signs_apart():
    assert C.signs_apart(1.0) == 0 and C.signs_apart(0.98) < 30 < C.signs_apart(0.9) and C.signs_apart(-1.0) == C.SIGNS
