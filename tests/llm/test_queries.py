"""Registered text queries against their SQL, and the pipeline stage by stage."""

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
import corpus_pipeline
from checks.compare import differences, open_duckdb
from holdfast.llm import bpe
from holdfast.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(entry_points.queries()[name](spark, SF), open_duckdb(SF), ORACLE[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, SF), name)
        held[name] = docs
        if name != "tokens":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in held[name].select("doc_id").collect()}
    assert ids("near_duplicates") < ids("toxicity") and ids("personal_data") == ids("near_duplicates")
    words = bpe.vocabulary(corpus_pipeline.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in held["mixture"].collect()}
    for r in held["tokens"].collect():
        assert r.round_trip and own.encode_ordinary(texts[r.doc_id]) == r.token_ids
