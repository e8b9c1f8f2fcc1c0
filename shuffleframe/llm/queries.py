"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, decontaminate, hmm_lm, language_id, quality_pu, sentencepiece_bpe, sharding, simhash, token_counts, warc
from .common import held_out, shared_dir, table


def piece_model() -> str:
    """The model file, from the public vocabularies that are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model(), ids=None, digests=True, keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 0))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    marked = warc.with_revisits(pages, "page_id", "payload", at_least=0)
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    path = shared_dir(spark)
    warc.write_warc(marked.select("record_type", name("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"), "payload"), path)
    found = warc.read_warc(spark, path, payload=False).where("record_type in ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) as bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2)).withColumn("learn", F.expr("not held_out"))
    learnable = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    return quality_pu.classify(docs, learnable, learn="learn", keep=["doc_id", "held_out"])


#: An id of the rank file's vocabulary that no text gives.
END_OF_DOCUMENT = 50_256


def byte_encoder():
    """The encoder of the public byte-level vocabulary with 50 256 ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    by = lambda pattern: tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return token_counts.by_runs(by(public_tokenizers.PATTERN), by(r"[\s\S]+"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_counts.write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark), byte_encoder, END_OF_DOCUMENT)
    found = token_counts.token_counts(written.select("file", "bytes"), END_OF_DOCUMENT)
    return written.select(F.col("id").alias("doc_id"), "file", "ordinal").join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 1))
    return hmm_lm.score_documents(docs, held_out="held_out", keep=["held_out"]).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_hmm_scores": op10_hmm_scores,
}
#: SQL for the queries that it can express; the others are tested against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """
with recursive usable as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98
), reached(a, b) as (
    select vec_id, vec_id from embeddings union select r.a, l.b from reached r join linked l on r.b = l.a
), lowest as (select a, min(b) as component_id from reached group by a)
select e.vec_id, (select count(*) from linked where linked.a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join lowest on lowest.a = e.vec_id""",
    "op4_warc": """
with hashed as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h,
        max(page_id) over (partition by coalesce(html, '')) as largest
    from pages
), words as (
    select *, list_transform(range(8), lambda g: ('0x' || substr(h, cast(g as int) * 5 + 1, 5))::int) as w from hashed
)
select page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[cast(i // 4 as int) + 1] >> (15 - 5 * cast(i % 4 as int))) & 31) + 1, 1)), '') as payload_digest,
    case when page_id = largest then 'response' else 'revisit' end as record_type,
    case when page_id = largest then null else largest end as refers_to
from words""",
}
