"""Stages that hand on whole rows: helper names as input columns, and null ids among equal texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import minhash, mixing, pii
from holdfast.llm.common import shielded

HELPERS = "_id _full _key _key2 _copy _row_id _spans _rows _copies _i _times toxicity own_0 own_1 score".split()
TEXT = " ".join(f"word{k}" for k in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "a"), (2, TEXT + " end", "b"), (3, "mail a.b@c.de now " + TEXT[::-1], None), (4, None, "a"), (None, TEXT, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select(*[F.lit(f"own {c}").alias(c) for c in HELPERS[:7]], "*", *[F.lit(7).alias(c) for c in HELPERS[7:]])


def test_shielded_names_come_back(docs):
    plain, back = shielded(docs, "doc_id", "text")
    assert {"doc_id", "text"} < set(plain.columns) and not set(plain.columns) & {"_id", "toxicity", "source"}
    assert back(plain.withColumn("_id", F.lit(0))).collect() == docs.collect()


def same(got, docs, ids=None):
    assert got.columns == docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    for r in got.collect():
        own = want[r.doc_id]
        assert all(r[c] == own[c] for c in docs.columns if c != "text")
    if ids is not None:
        assert Counter(r.doc_id for r in got.collect()) == Counter(ids)


def test_deduplicated(docs):
    same(minhash.deduplicated(docs, 2, 80), docs, [1, 3, 4])


def test_redacted(docs):
    got = pii.redact(docs)
    same(got, docs, [1, 2, 3, 4, None])
    assert "a.b@c.de" not in got.filter("doc_id = 3").first()["text"]


def test_mixed(docs):
    got = mixing.mixed(docs, share=1.5, stop=2.0)
    same(got, docs)
    assert got.filter("doc_id = 1").count() >= 1


def test_toxic_stage(spark, docs, tmp_path):
    spark.createDataFrame([(1, 0), (3, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    same(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)), docs, [1, 2, 3, 4, None])


def test_null_ids_name_no_component(spark):
    rows = [(None, TEXT), (5, TEXT), (6, TEXT + " x"), (None, "other words " * 9), (8, "other words " * 9), (None, "only here and there")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 5), (5, 5), (6, 5), (None, 8), (8, 8), (None, None)}
    assert {r.doc_id for r in got if r.kept} == {5, 8, None}
    left = minhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect()
    assert Counter(r.doc_id for r in left) == Counter([5, 8, None])
