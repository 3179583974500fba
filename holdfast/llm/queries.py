"""Queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import (
    bpe,
    minhash,
    mixing,
    negatives,
    pii,
    search,
    secrets,
    simhash,
    spelling,
    suffixes,
    toxicity,
    warc,
    webtext,
)
from holdfast.llm.common import stage, table
from holdfast.session import scratch_dir


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    docs = table(spark, sf_dir, "documents")
    return simhash.fingerprinted(docs, simhash.NEAR_COPIES, simhash.NEAR_BLOCKS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, read back and assembled."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/warc"
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    records = stage(warc.read_records(spark, path, with_payload=False), "records")
    rows = stage(
        warc.captures(records).select(
            "capture_id", warc.page_id_of(F.col("metadata")).alias("page_id"), "response"
        ),
        "captures",
    )
    kept = rows.filter("response.kind = 'response'").select(
        F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"),
        F.col("response.payload_bytes").alias("full_bytes"), F.col("response.payload_digest").alias("full_digest"),
    )
    kept = stage(kept, "responses")
    joined = rows.withColumn("refers", F.col("response.refers_to")).join(kept, "refers", "left")
    return joined.select(
        "page_id",
        F.coalesce("full_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        "refers_to",
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents."""
    plan = mixing.mixture(table(spark, sf_dir, "documents"), share=1.5, stop=2.0)
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that start more than once."""
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.all_spans().alias("spans")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of held-out rows are not read."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (~toxicity.may_learn(F.col("doc_id"))).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their two-word shingles."""
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best vectors for each vector whose id is divisible by 20."""
    found = search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return webtext.main_texts(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; every seventh label is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    found = negatives.hard_negatives(vectors, F.col("id") % 50 == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words of every word of all documents, some letters deleted as planted."""
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), planted_every=97))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_mix_sources": op3_mix_sources,
        "op4_secrets": op4_secrets,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_personal_data": op6_personal_data,
        "op7_toxicity": op7_toxicity,
        "op8_bpe": op8_bpe,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_topk_search": op10_topk_search,
        "op11_main_text": op11_main_text,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_spelling_variants": op13_spelling_variants,
    }
