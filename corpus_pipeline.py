"""Training text from documents: toxic documents go, one of each group of near copies stays, personal
data is masked, sources are mixed to their targets, and texts become token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
docs of the next. All but the last return the columns of documents. Null texts pass every stage as
empty ones do; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, minhash, mixing, pii, toxicity
from holdfast.llm.common import shielded, short_batches, stage, table

TOXIC_FROM = 0.7
SHINGLE_WORDS = 5
LIKE_PERCENT = 80
SHARE, MOST_COPIES = 1.5, 2.0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the model learns from the labels of allowed rows."""
    short_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain, back = shielded(docs, "doc_id", "text")
    return back(toxicity.score(plain, model).filter(F.col("toxicity") < TOXIC_FROM))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    short_batches(spark)
    return minhash.deduplicated(docs, SHINGLE_WORDS, LIKE_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    short_batches(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs, share=SHARE, stop=MOST_COPIES)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    short_batches(spark)
    encoded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return encoded.withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixture", mix),
    ("tokens", tokenise),
]

# Scores, sketches and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
