import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shuffleframe.llm import simhash as H
from shuffleframe.llm.components import connected_components


def plain(text, width=4):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    low = {n: n for n in nodes}
    while True:
        old = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if old == low:
            return low


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="Ab \t\n\x0bé\x1c\x85", max_size=60)))
def test_fingerprint(text):
    assert H.fingerprint(text) == plain(text)


def test_blocks_of_long_texts(monkeypatch):
    text = " ".join(random.Random(1).choices(["Aa", "bé", "c", "dd\n"], k=5000))
    whole = H.word_blocks
    monkeypatch.setattr(H, "word_blocks", lambda t: whole(t, 97))
    assert H.fingerprint(text) == plain(text)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    nodes = {x for p in pairs for x in p}
    want = components(nodes, pairs)
    rows = connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 16)
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(30, 80))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (None, "one two"), (5, "x " * 50000)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((10 + i, " ".join(words)))
    rows += rows[20:25]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component string, fp int")
    prints = {(i, t): plain(t) for i, t in rows}
    known = [(i, f) for (i, _), f in prints.items() if i is not None]
    links = [(a, b) for a, f in known for b, g in known if a < b and (f ^ g).bit_count() <= 4]
    want = components([i for i, _ in known], links)
    got = H.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.id is None, r.id, r.fp % 2**64, r.component) for r in got if r.id is not None) == sorted((False, i, prints[i, t], want[i]) for i, t in rows if i is not None)
    assert [r.component for r in got if r.id is None] == [None]
    assert H.near_duplicates(docs.limit(0)).collect() == []


def test_linked_finds_all_pairs_in_chunks(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(12) | (rng.getrandbits(4) << 60) for _ in range(200)} | {2**64 - 1, 0, 2**63, 2**63 - 1}
    nodes = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame(nodes, "fp long, node long")
    got = connected_components(H.links(frame, chunk=8))
    want = components([n for _, n in nodes], [(a, b) for f, a in nodes for g, b in nodes if a < b and ((f ^ g) % 2**64).bit_count() <= 4])
    low = {r.node: r.component for r in got.collect()}
    assert {n: low.get(n, n) for _, n in nodes} == want


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randrange(2, 7)))
    base = [[word() for _ in range(rng.randrange(120, 400))] for _ in range(40)]
    rows = []
    for words in base:
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows if i is not None and t}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    got = {r.id: r.component for r in H.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(a, b) for a in shingles for b in shingles if a < b and alike(a, b) >= 0.8]
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near) > 20
    assert not [(a, b) for a in shingles for b in shingles if got[a] == got[b] and alike(a, b) < 0.3]
    assert got[900] == got[901] == 900 and got[None] is None
    keys = H.order_keys(np.array([[1, 2, 3, 4], [1, 2, 3, 4 + 2**40]], np.uint64))
    assert keys.shape == (2, 72) and (keys[0] != keys[1]).sum() == 6


def test_shingle_sets(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "one", "one two three four five", " ".join(rng.choices(["Aa", "b", "c"], k=600)), " ".join(f"w{i}" for i in range(300))]
    whole = H.word_blocks
    for size in (1 << 20, 3, 50):
        monkeypatch.setattr(H, "word_blocks", lambda t, size=size: whole(t, size))
        got = {r.id: set(r.shingles) for r in H.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "id", "text", 5).collect()}
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            want = {xxhash.xxh64_intdigest(" ".join(words[k : k + 5]), seed=42) for k in range(max(1, len(words) - 4))} if words else set()
            assert {x % 2**64 for x in got[i]} == want, (size, i)


def test_candidates_are_verified(spark):
    """Pairs that only the further keys find are linked from a similarity of 0.8 on, and not below."""
    a = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", *a])), (3, " ".join([*a[:120], *[f"z{i}" for i in range(80)]])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = H.with_fingerprints(docs, width=5, seeds=H.SEEDS, more=H.MORE)
    distinct = prints.groupBy(*H.columns(len(H.SEEDS) + H.MORE)).agg({"id": "min"}).withColumnRenamed("min(id)", "node")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    assert sorted(map(tuple, H.verified(pairs, distinct, docs, "doc_id", "text", 5).collect())) == [(1, 2)]
    assert sorted(map(tuple, H.verified(pairs, distinct, docs, "doc_id", "text", 5, 0.3).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert (H.fingerprints(rows[0][1], 5, (42, 43), 2)[:2] == H.fingerprints(rows[0][1], 5, (42, 43))).all()


def test_large_classes_end_with_the_first_join(spark, monkeypatch):
    """Rows under the keys of all bits don't grow with a class that 256 bits link; other texts end in the same classes, whatever the chunks are."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    base, other = [word() for _ in range(200)], [word() for _ in range(200)]
    rows = [(0, " ".join(other)), (1, " ".join([word(), *other]))]
    for i in range(160):
        copy = list(base)
        copy[rng.randrange(200)] = word()
        rows.append((10 + i, " ".join(copy)))
    whole, made = H.in_chunks, []

    def counted(*args, **kwargs):
        out = whole(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(H, "in_chunks", counted)
    for n, chunk in ((80, 512), (160, 512), (160, 16)):
        docs = spark.createDataFrame(rows[: 2 + n], "doc_id long, text string")
        got = {r.id: r.component for r in H.near_copies(docs, chunk=chunk).collect()}
        assert got == {0: 0, 1: 0} | {10 + i: 10 for i in range(n)}
        assert made[-1] <= 2 * 120, (n, chunk, made)


def test_candidates_of_different_classes(spark):
    """All pairs of different components that are near enough, in chunks or not, and no others."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 16, np.uint64)
    fps = np.stack([base ^ np.array([sum(1 << int(b) for b in set(rng.integers(16, 64, k))) for _ in range(16)], np.uint64) for k in rng.integers(0, 14, 40)])
    names = H.columns(16)
    distinct = spark.createDataFrame([(i, *map(int, f), i % 3) for i, f in enumerate(fps.view(np.int64))], ", ".join(f"{c} long" for c in ["node", *names, "component"])).cache()
    apart = lambda a, b, n: int(np.bitwise_count(fps[a, :n] ^ fps[b, :n]).sum())
    want = {(a, b) for a in range(40) for b in range(a) if a % 3 != b % 3 and apart(a, b, 4) <= 40 and apart(a, b, 16) <= 150}
    blocks = np.concatenate([H.order_keys(fps[:, :4]), H.order_keys(fps, 1, H.MORE_SPLIT)], axis=1)
    want = {(b, a) for a, b in want if (blocks[a] == blocks[b]).any()}
    assert len(want) > 50
    for chunk in (512, 4):
        key = ["choice", "bits", "low", "high"]
        dealt = H.in_chunks(H._keyed(distinct, names, ["component"]), ["choice", "bits"], chunk, "node", differing="component").join(distinct.drop("component"), "node")
        sent = dealt.select(*key, "own", "component", *names, "node").repartition(*key).sortWithinPartitions(*key)
        got = H.arrow_map(sent, H._candidates(4, 40, 12, 150), "a long, b long").distinct().collect()
        assert {tuple(r) for r in got} == want, chunk
