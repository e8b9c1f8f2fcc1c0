"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again.

Every stage returns the columns of documents, and further ones that they have, of whatever name; the last one returns doc_id
and the tokens. Tables without rows give results without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shuffleframe.llm import decontaminate, language_id, quality_pu, queries, sentencepiece_bpe, simhash
from shuffleframe.llm.common import KEPT, materialise, named, packed, shared_dir, table, unpacked  # noqa: F401


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: without a letter (null and empty texts too), or unlike every language learned from docs. Texts of any length are read whole; equal texts are decided alike."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model, prefix="__language_").where("not __language_rejected").select(*map(named, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, learned from docs and their labels, scores below its threshold. Null and empty texts are scored as the empty text, texts of any length whole; equal texts are decided alike. Without trusted positives nothing is known to be good and everything goes."""
    plain = docs.select(packed(docs.columns))
    of = lambda c: unpacked(docs.columns)[docs.columns.index(c)]
    scored = quality_pu.classify(plain.withColumns({"doc_id": of("doc_id"), "text": of("text")}), table(spark, sf_dir, "labels"), keep=[KEPT])
    return scored.where("predicted = 1").select(*unpacked(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similar by about 0.8 or more) the document with the smallest id stays. Rows with a null id are compared too and go before none with an id; rows that repeat an id with other texts are documents of their own; of equal rows one stays. Null and empty texts are equal texts."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other numbers, names or units; each row by its own text, whatever its id. Null and empty texts hold none; texts of any length are read whole; equal texts are decided alike."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each whole text, with their number and digests: a row for each row. Null and empty texts have no ids."""
    return sentencepiece_bpe.encode_documents(docs, queries.piece_model(), digests=True, keep=["doc_id"])


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
