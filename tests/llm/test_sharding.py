import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from shuffleframe.llm import sharding as S


def test_pack_balances_jointly():
    rng = np.random.default_rng(1)
    v = rng.lognormal(0, 1, (3000, 3))
    placed = S.pack(v, 24)
    loads = np.array([v[placed == s].sum(axis=0) for s in range(24)])
    assert (loads.max(axis=0) / loads.mean(axis=0)).max() < 1.01
    assert S.pack(np.zeros((5, 3)), 3).tolist() == S.pack(np.zeros((5, 3)), 3).tolist()


def test_frame(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 97 == 0 else " ".join(rng.choices(["ab", "cé", "d"], k=rng.randrange(0, 60)))) for i in range(4000)]
    rows += [(10_000 + i, "the same text") for i in range(2000)] + [(20_000, "long " * 50_000), (None, "x"), (5, rows[5][1]), (30_000, "")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, shard int, cell string")
    got = S.shard_documents(docs, 24, pieces=8).collect()
    assert Counter(r.id for r in got) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
    text = dict(rows)
    for r in got:
        data = (text[r.id] or "").encode()
        assert (r.size, r.text_crc32, r.tokens) == (len(data) + 8, zlib.crc32(data), len((text[r.id] or "").split()))
    shard_of = defaultdict(set)
    for r in got:
        shard_of[text[r.id]].add(r.shard)
    assert all(len(s) == 1 for t, s in shard_of.items() if t is not None and t != "the same text" and len(t) > 9)
    assert S.shard_documents(docs.limit(0), 24).collect() == []


def test_balance_without_giants(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "repeat('word ', cast(20 + pmod(xxhash64(id), 200) as int)) text")
    got = S.shard_documents(docs.withColumn("text", docs.text), 24, cells=64).groupBy("shard").agg({"size": "sum", "*": "count"}).toPandas()
    size, n = got["sum(size)"], got["count(1)"]
    assert size.max() / size.mean() < 1.02 and n.max() / n.mean() < 1.05


def test_groups_that_fit_a_shard_stay_whole(spark):
    rows = [(i, f"small {i} " + "word " * (i % 150)) for i in range(12_000)]
    heavy = [f"group {g} " + "word " * n for g, n in enumerate([74, 74, 74, 74])]
    rows += [(20_000 + 1000 * g + i, t) for g, (t, n) in enumerate(zip(heavy, [50, 150, 250, 300], strict=True)) for i in range(n)]
    giant = "larger than a shard " + "word " * 75
    rows += [(40_000 + i, giant) for i in range(900)]
    got = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).toPandas()
    got["text"] = got["id"].map(dict(rows))
    shards = got.groupby("text")["shard"].nunique()
    assert (shards.drop(giant) == 1).all()
    assert shards[giant] == 2
    for loads in (got.groupby("shard")["size"].sum(), got.groupby("shard")["tokens"].sum(), got.groupby("shard").size()):
        assert len(loads) == 24 and loads.max() / loads.mean() < 1.04
