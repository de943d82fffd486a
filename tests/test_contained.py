"""Patterns in texts against a search of each for each, in shards of all sizes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import contained as op
from quillspark.operators import imports


def some(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab./é\U0001f600") for _ in range(r.randint(1, n)))
    texts, patterns = [word(14) for _ in range(200)] + ["", "zz", None], [word(4) for _ in range(90)] + ["", "b" * 9, None, "zz"]
    return spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), {(t, p) for t in texts for p in patterns if t is not None and p is not None and p in t}


@pytest.mark.parametrize(("a_shard", "a_task"), [(10_000, 10_000), (7, 20), (1, 1000)])
def test_against_each_for_each(spark, a_shard, a_task):
    texts, patterns, want = some(spark)
    got = [tuple(x) for x in op.contained(texts, patterns, a_shard, a_task).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_shards_of_a_text_hold_all_that_it_contains():
    r = random.Random(2)
    patterns = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(300)})
    for size in (1, 3, 17, 400):
        lows = patterns[::size]
        for _ in range(200):
            text = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
            need = {k // size for k, p in enumerate(patterns) if p in text}
            assert need <= op.shards_of(text, lows) <= set(range(len(lows)))
            assert len(lows) == 1 or len(op.shards_of(text, lows)) <= 1 + sum(len(text) - k for k in range(len(text)))


def test_nothing_to_find(spark):
    texts, patterns, _ = some(spark)
    assert op.contained(texts, patterns.limit(0)).count() == 0
    assert op.contained(texts.limit(0), patterns).count() == 0


def test_an_import_that_all_files_have(spark, monkeypatch):
    import functools

    n = 3000
    corpus = spark.range(n).select(F.col("id").alias("scan_index"), F.concat(F.lit("src/f"), F.col("id"), F.lit(".ts")).alias("path"), F.concat(F.lit("import { a } from './f1';\nimport { b } from './f"), F.col("id") % 50, F.lit("';\n")).alias("content"))
    monkeypatch.setattr(imports, "joined_hot", functools.partial(imports.joined_hot, hot_rows=100))
    got = {(r.base, r.j) for r in imports.holders(corpus, patterns_a_shard=500, texts_a_task=13).collect()}
    deps = [{"src/f1", f"src/f{k % 50}"} for k in range(n)]
    assert got == {(f"f{i}", j) for j in range(n) for i in range(50) if any(f"f{i}" in d for d in deps[j])}
