"""Every operator and stage over nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from quillspark.llm import entry

ONE_ROW_EACH = ["op1_secrets", "op2_quality_rules", "op4_masked_likelihood", "op5_token_binary", "op6_mixing", "op7_simhash", "op8_licenses", "op9_quality_classifier", "op11_alignment", "op13_toxicity"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, empty_sf, name):
    found = entry.queries()[name](spark, empty_sf)
    assert found.count() == (1 if name == "op3_chat" else 0)  # op3 adds a conversation of its own


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(spark, sf, name):
    found = entry.queries()[name](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()
    assert sorted(found.doc_id.fillna(-1)) == sorted(docs.doc_id.fillna(-1))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_edge_cases(spark, sf, empty_sf, edge_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, edge_docs, sf)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert found.columns == edge_docs.columns
        held = found.toPandas()
        assert (held["tail"] == "mine tail").all() and (held["_kept"] == "mine _kept").all()
    else:
        assert found.count() == edge_docs.count()
    assert stage(spark, no_docs, empty_sf).count() == 0
    assert stage(spark, edge_docs.select("doc_id", "text", "lang", "source", "n_chars"), empty_sf).count() > 0


def test_pipeline_runs_through(spark, sf):
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} == set(corpus_pipeline.run(spark, sf).columns)
