import hashlib

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from shuffleframe.llm import decontaminate, language_id, quality_pu, simhash


def test_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    frame = lambda ids: spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id in ({','.join(map(str, ids))})")
    model = language_id.fit(frame(docs))
    kept = [i for i, r in docs.items() if not model.predict([r.text])[2][0]]
    # the classifier's fit is tested by itself; here its decisions
    scored = quality_pu.classify(frame(kept), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = sorted(r.doc_id for r in scored if r.score >= 0.7)
    prints = np.array([simhash.fingerprints(docs[i].text, 5, simhash.SEEDS) for i in kept])
    blocks = simhash.order_keys(prints)
    number = {i: k for k, i in enumerate(kept)}
    alike = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= simhash.APART) & (blocks[:, None] == blocks[None]).any(axis=2)
    low = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if low[b] < low[a] and alike[number[a], number[b]]:
                    low[a] = low[b]
                    changed = True
    kept = [i for i in kept if low[i] == i]
    norm = lambda t: " ".join(w for w in (x.strip(decontaminate._STRIP).lower() for x in t.split()) if w)
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    must_go = {i for i in kept if any(f" {t} " in f" {norm(docs[i].text)} " for t in items)}
    may_go = {i for i in kept if any(" ".join(t.split()[k : k + 8]) in norm(docs[i].text) for t in items for k in range(max(1, len(t.split()) - 7)))}
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert set(kept) - may_go <= set(got) <= set(kept) - must_go
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in got.items():
        ids = library.encode(docs[i].text, num_threads=1)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "The and of was her", "en", None, None), (-1, None, None, None, 0), (-2, "", "en", "x", 0), (-3, "12 34", None, "x", 5)], docs.schema)
    for extra in (docs.limit(60).unionByName(odd).unionByName(docs.limit(3)), docs.limit(0)):
        at = extra.withColumn("score", F_lit("clash")).withColumn("predicted", F_lit("clash"))
        n = at.count()
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, at, sf)
            assert out.columns == at.columns, name
            assert out.count() <= n
            at = C.materialise(out)
        assert at.groupBy("doc_id").count().where("count > 1 and doc_id is not null").count() == 0
        assert C.tokens(spark, at, sf).count() == at.count()


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_repeated_and_null_ids(spark):
    """Rows are decided by their own text: an id that is repeated or null neither saves nor loses another row."""
    sf = "/root/testdata/sf0.001"
    words = [f"word{i * 7919 % 1000}" for i in range(400)]
    text = lambda k, n=120: " ".join(words[k : k + n])
    near = text(0).replace("word0 ", "other ", 1)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(5, text(0)), (5, text(130)), (6, text(0)), (4, near), (None, text(130)), (None, text(260)), (None, f"{text(200, 50)}. {item} {text(150, 50)}"), (9, item), (9, text(300, 90)), (9, text(300, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", "kept?") for i, t in rows], "doc_id long, text string, lang string, source string, `a.b` string")
    kept = C.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(4, near), (5, text(130)), (0, text(260)), (0, rows[6][1]), (9, item), (9, text(300, 90))])
    clean = C.decontamination(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if item not in t)
    for _, stage in C.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} <= {"kept?"}
    last = C.tokens(spark, docs, sf).collect()
    assert len(last) == len(rows) and all(r.n_tokens == len(r.ids) > 0 for r in last)


def test_recall_of_near_duplicates(spark):
    """Of pairs of texts whose shingles of five words are similar by 0.8 or more, compared one by one, nine in ten end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").dropDuplicates(["text"])
    words = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    shingles = {i: {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    by = {}
    for i, s in shingles.items():
        for x in s:
            by.setdefault(x, []).append(i)
    met = {(a, b) for x in by.values() for a in x for b in x if a < b}
    alike = [(a, b) for a, b in met if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    got = {r.id: r.component for r in simhash.near_copies(docs).collect()}
    assert sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)
