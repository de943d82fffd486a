"""The pipeline's stages on sf0.001, each against a plain version on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import ordinal
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_mixing import dealt
from tests.llm.test_simhash import brute_similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage gets and gives."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{top}/{k}")
        found = spark.read.parquet(f"{top}/{k}")
        out.append((docs, found))
        docs = found
    return out


def ids(df) -> list:
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, steps):
    docs, found = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tail = {r["doc_id"]: r["tail"] for r in ordinal.score(docs, ordinal.train(docs, labels)).collect()}
    assert ids(found) == sorted(i for i, t in tail.items() if t >= 0.5)


def test_near_duplicates(steps):
    docs, found = steps[1]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert ids(found) == sorted({rows[k][0] for k in brute_similar([t for _, t in rows])})


def test_benchmark_passages(spark, steps):
    docs, found = steps[2]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    leaking = {d for d, _ in brute_leaks(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert ids(found) == sorted({d for d, _ in rows} - leaking)


def test_mix(steps):
    docs, found = steps[3]
    rows = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()}
    sums: dict = {}
    for s, n in rows.values():
        sums[s] = sums.get(s, 0) + n
    taken: dict = {}
    for i in ids(found):
        taken[i] = taken.get(i, 0) + 1
    assert max(taken.values()) <= 3
    want = dealt(sums)
    for s in sums:
        near = max(n for t, n in rows.values() if t == s)
        assert abs(sum(k * rows[i][1] for i, k in taken.items() if rows[i][0] == s) - want[s]) <= near


def test_token_ids(steps):
    docs, found = steps[4]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        x = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(want)
