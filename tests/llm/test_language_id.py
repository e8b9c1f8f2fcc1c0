import random

import numpy as np
import pytest

from shuffleframe.llm import language_id as L
from shuffleframe.llm import queries

WORDS = {"en": "the and of to in that was with thing over", "de": "der die und nicht mit über schön straße zu ein", "fr": "le la et où été que dans être une pour", "ru": "и в не на что был это как его но"}


def text(rng, lang, n=30):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def plain_counts(value):
    letters = "".join(c if c.isalpha() else " " for c in value.lower()).split()
    x = np.array([ord(c) for c in " " + " ".join(letters) + " " * (not value.lower()[-1:].isalpha())], np.uint32)
    total = np.zeros(L.FEATURES, np.int64)
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            h = int(x[i]) * 0x9E3779B1 % 2**32
            for c, m in zip(x[i + 1 : i + n], (0x85EBCA77, 0xC2B2AE3D), strict=False):
                h = (h * 31 + int(c) * m) % 2**32
            total[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 19] += 1
    return total


def test_counts(monkeypatch):
    value = "Ab  c, dé9f!! gh\nAb" * 3
    whole = L.counts(value)
    assert (whole == plain_counts(value)).all()
    monkeypatch.setattr(L, "PIECE", 5)
    assert (L.counts(value) == whole).all()
    assert L.counts("12 !") is None and L.counts("") is None and L.counts(None) is None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, text(rng, k), k if i % 9 else None, 0.5) for i in range(400) for k in [rng.choice(list(WORDS))]]


def test_fit_and_predict(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit(docs)
    assert model.languages == sorted(WORDS)
    rng = random.Random(7)
    new = [(i, text(rng, k), k) for i in range(100) for k in [rng.choice(list(WORDS))]]
    odd = [(1000, None, None), (1001, "", None), (1002, "12 -- !!", None), (1003, "the " * 300_000, "en"), (1004, "漢字 かな " * 20, None), (1004, "漢字 かな " * 20, None)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(new + odd, "doc_id long, text string, score string"), model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, k in new)
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003].lang_pred == "en" and got[1004].rejected
    assert L.predict(docs.limit(0), model).collect() == []
    # the plain way gives the same
    plain = [int((model.centroids @ L.unit(np.log1p(plain_counts(t)) * model.idf)).argmax()) for _, t, _ in new]
    assert [model.languages[model.owner[c]] for c in plain] == [k for _, _, k in new]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    got = L.predict(docs, L.fit(docs)).collect()[0]
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def test_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_rejects_scripts_and_noise_with_junk_in_training(spark):
    """One-word and junk texts among those to learn from, and copies of them, switch no limit off; short clean texts stay."""
    rng = random.Random(12)
    noise = lambda n: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(2, 9))) for _ in range(n))
    known = [(text(rng, k, rng.choice([1, 2, 3, 8, 30, 100])), k) for k in ("en", "de", "fr") for _ in range(500)]
    known += [(t, k) for k in ("en", "de", "fr") for t in [noise(1), noise(5), noise(40), "SCUM!! TION!! " * 9, "Erö."] for _ in range(100)]
    model = L.fit(spark.createDataFrame(known, "text string, lang string"))
    odd = [x * n for x in ("мама мыла раму и пошла в лес ", "漢字 かな 日本 の 人 が ") for n in (1, 4, 40)] + [noise(n) for n in (8, 30, 100, 300)]
    assert all(model.predict(odd)[2])
    clean = [(text(rng, k, n), k) for k in ("en", "de", "fr") for n in (1, 2, 3, 8, 30, 100) for _ in range(10)]
    got = model.predict([t for t, _ in clean])
    assert not any(got[2])


def test_every_language_is_learned(spark):
    """Languages whose rows are mostly copies of few texts, and more languages than 200."""
    rng = random.Random(21)
    few = [(text(rng, k), k) for k in ("de", "fr") for _ in range(20)]
    known = [(t, k) for t, k in few for _ in range(1_000)] + [(text(rng, "en"), "en") for _ in range(300)]
    model = L.fit(spark.createDataFrame(known, "text string, lang string"), sample=20)
    assert [(model.owner == i).sum() for i in range(3)] == [3] * 3
    assert model.predict([t for t, _ in few])[0] == [k for _, k in few]
    many = {f"l{i:03d}": " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)) for i in range(205)}
    model = L.fit(spark.createDataFrame([(t, k) for k, t in many.items()], "text string, lang string"))
    assert model.predict(list(many.values()))[0] == list(many)
