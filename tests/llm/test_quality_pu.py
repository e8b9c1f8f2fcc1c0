import random

import numpy as np
import pytest

from shuffleframe.llm import quality_pu as P
from shuffleframe.llm import queries


def good(rng):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) + rng.choice("xyz") + str(i % 7)[:0] + rng.choice("klmnop") for i in range(rng.randrange(30, 90))).capitalize() + "."


def bad(rng):
    return rng.choice([lambda: good(rng).upper().replace(" ", "!! "), lambda: good(rng).replace(" ", "$$$ "), lambda: ("spam " * 60)])()


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    rows = [(i, good(rng) if y else bad(rng), y) for i in range(1200) for y in [int(rng.random() < 0.8)]]
    return rows, [(i, y) for i, _, y in rows if rng.random() < 0.3]


def test_features(monkeypatch):
    x = P.features("Aa bb  BB bb bb!!\n\nline $\nline $\n12")
    assert x.shape == (P.DIM,) and np.isfinite(x).all() and (x >= 0).all()
    assert (P.features(None) == 0).all() and (P.features("") == 0).all() and np.isfinite(P.features("\x00 \x01")).all()
    text = " ".join(f"w{i}" for i in range(2000))
    whole = P.features(text)
    monkeypatch.setattr(P, "PIECE", 500)
    pieces = P.features(text)
    same = [i for i, n in enumerate(P.NAMES) if n not in ("lines", "same_lines")]
    assert np.allclose(whole[same], pieces[same])


def test_fit_matches_plain_descent(spark, made):
    rows, labels = made
    x = np.stack([P.features(t) for _, t, _ in rows])
    known = dict(labels)
    positive = np.array([known.get(i) == 1 for i, _, _ in rows])
    frame = spark.createDataFrame([(v.tobytes(), bool(p)) for v, p in zip(x, positive, strict=True)], "x binary, positive boolean")
    prior = P.estimate_prior(sum(known.values()), len(known))
    model = P.fit(frame, prior)
    z = P.design(x, x.mean(axis=0), x.std(axis=0) + 0.02)
    assert np.allclose(P.design(x, model.mean, model.scale), z)

    def risk(w):
        f = z @ w
        return prior * np.logaddexp(0, -f[positive]).mean() + max(0.0, np.logaddexp(0, f).mean() - prior * np.logaddexp(0, f[positive]).mean()) + P.RIDGE / 2 * w @ w

    w = np.zeros(z.shape[1])
    for _ in range(4000):
        f = z @ w
        s = 1 / (1 + np.exp(-f))
        rest = s @ z / len(z) - prior * (s[positive] @ z[positive]) / positive.sum()
        if np.logaddexp(0, f).mean() - prior * np.logaddexp(0, f[positive]).mean() < 0:
            w = w + 0.1 * rest
        else:
            w = w - 0.1 * (-prior * ((1 - s[positive]) @ z[positive]) / positive.sum() + rest + P.RIDGE * w)
    assert risk(model.weights) < risk(w) + 0.05


def test_classify(spark, made):
    rows, labels = made
    docs = spark.createDataFrame([(i, t, i % 4 != 2, "x") for i, t, _ in rows] + [(5000, None, True, None), (5001, "", False, None), (None, "abc", True, "y"), (5002, "Word " * 200_000, True, None), (0, rows[0][1], True, "x")], "doc_id long, text string, learn boolean, score string")
    got = P.classify(docs, spark.createDataFrame([x for x in labels if x[0] % 4 != 2] + [(5000, None), (None, 1)], "doc_id long, quality int"), learn="learn").collect()
    assert len(got) == len(rows) + 5 and set(got[0].asDict()) == {"doc_id", "text", "learn", "score", "predicted"}
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(i, y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([by[i].predicted == y for i, y in held]) > 0.93
    none = P.classify(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in none.collect()} == {0.5}
    assert P.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_held_out_accuracy(spark):
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_every_feature_is_of_the_whole_text(monkeypatch):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choices(["the", "OF", "x!!", "a" * 25, "é", "12", "$$"], k=rng.randrange(0, 9))) for _ in range(300)), "one line " * 900, "\n" * 3000, "same line of words\n" * 200, "w" * 5000]
    whole = [P.features(t) for t in texts]
    for size in (1, 7, 500):
        monkeypatch.setattr(P, "PIECE", size)
        assert all((P.features(t) == x).all() for t, x in zip(texts, whole, strict=True))


def test_prior_without_negative_labels(spark):
    """From trusted positives and all texts, for several parts of positives; which negatives are labelled changes nothing."""
    rng = random.Random(15)
    for part in (0.5, 0.9):
        rows = [(i, good(rng) if y else bad(rng), y) for i in range(2000) for y in [int(rng.random() < part)]]
        labels = [(i, y) for i, _, y in rows if rng.random() < 0.4]
        table = spark.createDataFrame([(i, True, P.features(t).tobytes()) for i, t, _ in rows], "id long, learn boolean, x binary").cache()
        frame = lambda known: spark.createDataFrame(known, "id long, label int")
        model = P.fit_model(table, frame(labels))
        assert abs(model.prior - part) < 0.08
        assert P.fit_model(table, frame([x for x in labels if x[1]])).prior == pytest.approx(model.prior)


def test_prior_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    table = P.with_features(docs, ["doc_id"]).selectExpr("kept.`0` id", "true learn", "x").cache()
    share = labels.agg({"quality": "avg"}).first()[0]
    assert abs(P.fit_model(table, labels.toDF("id", "label")).prior - share) < 0.05


def test_query_scores_against_plain_ones(spark):
    """The query's scores are those of the model fitted on the rows to learn from, computed one by one."""
    from shuffleframe.llm.common import held_out

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.where(~held_out("doc_id", 4, 2)).collect() if r.quality == 1}
    rows = [(r.doc_id, P.features(r.text).tobytes(), r.doc_id in good) for r in docs.where(~held_out("doc_id", 4, 2)).collect()]
    model = P.fit(spark.createDataFrame(rows, "doc_id long, x binary, positive boolean").selectExpr("x", "positive", "pmod(xxhash64(doc_id), 2) half"))
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == text.keys()
    for i, r in got.items():
        assert abs(r.score - model.score(P.features(text[i])[None])[0]) < 1e-6 and r.predicted == (r.score >= 0.7)
