"""Extra columns of any name: every operator gives the same with them as without."""

import pytest
from pyspark.sql import functions as F

from shuffleframe.llm import cap_filters, decontaminate, hmm_lm, language_id, quality_pu, queries, sentencepiece_bpe, sharding, simhash, token_counts, warc

#: Names of columns that operators use themselves, and names that need quoting.
CLASHES = ["x", "row", "score", "a.b", "id", "words", "times", "classes", "kept", "own", "learn", "positive", "fp", "component", "cell", "shard", "predicted", "rejected", "__id", "__text", "__source_text", "part", "tick`s", "n_tokens"]
ROWS = [(i, f"the quick brown fox {i % 7} jumps over the lazy dog number {i} and runs far away from all the others" * (1 + i % 3), "en") for i in range(40)] + [(None, "a text", "en"), (7, None, None), (8, "", "en"), (9, "und so weiter und so fort", "de"), (9, "und so weiter und so fort", "de")]


def crowded(df, but=()):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in but})


def same(plain, crowd, extra=()):
    """Equal rows in the columns of plain; the extra columns as they were."""
    quoted = lambda df, names: df.select(*["`" + c.replace("`", "``") + "`" for c in names])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, quoted(plain, plain.columns).collect()), key=key) == sorted(map(tuple, quoted(crowd, plain.columns).collect()), key=key)
    if extra:
        assert {tuple(r) for r in quoted(crowd, extra).collect()} == {tuple(f"clash {c}" for c in extra)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").cache()


def test_operators_that_keep_columns(spark, docs):
    but = lambda *names: [c for c in CLASHES if c not in names]
    encode = lambda d, **k: sentencepiece_bpe.encode_documents(d, queries.piece_model(), **k)
    same(encode(docs, digests=True, ids=None), encode(crowded(docs), digests=True, ids=None), but("n_tokens"))
    both = encode(docs, digests=True, decoded="back").where("lang = 'de'").first()
    assert both.back == ROWS[-1][1] and both.n_tokens == len(both.ids)
    model = language_id.fit(docs)
    same(language_id.predict(docs, model), language_id.predict(crowded(docs), model), but("score", "rejected"))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, quality int, low string")
    same(quality_pu.classify(docs, labels), quality_pu.classify(crowded(docs), labels), but("score", "predicted"))
    scores = lambda d, keep: hmm_lm.score_documents(d, keep=keep, states=2, rounds=1)
    same(scores(docs, ["lang"]), scores(crowded(docs), ["lang", *CLASHES]), but(*hmm_lm.RESULTS))
    pages = docs.select("doc_id", F.encode(F.col("text"), "UTF-8").alias("payload"))
    same(warc.with_revisits(pages, "doc_id", "payload"), warc.with_revisits(crowded(pages), "doc_id", "payload"), CLASHES)


def test_operators_that_read_their_columns_only(spark, docs, tmp_path):
    same(simhash.near_duplicates(docs), simhash.near_duplicates(crowded(docs)))
    same(simhash.near_copies(docs), simhash.near_copies(crowded(docs)))
    same(sharding.shard_documents(docs, 4), sharding.shard_documents(crowded(docs), 4))
    bench = spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string")
    same(decontaminate.contaminated(docs, bench), decontaminate.contaminated(crowded(docs), crowded(bench)))
    vectors = docs.where("doc_id is not null").select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id") % 3).alias("embedding"), F.lit(1).alias("label"))
    same(cap_filters.near_duplicates(vectors), cap_filters.near_duplicates(crowded(vectors)))
    counts = lambda d, name: (w := token_counts.write_token_files(d, f"file://{tmp_path}/{name}", queries.byte_encoder, queries.END_OF_DOCUMENT)).select("id", "file", "ordinal").join(token_counts.token_counts(w, queries.END_OF_DOCUMENT), ["file", "ordinal"]).select("id", "n_tokens")
    same(counts(docs, "a"), counts(crowded(docs), "b"))
