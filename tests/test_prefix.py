"""Sums along ranges against plain ones, and how many rows a task gets of a name that everything has."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import imports, prefix


@pytest.mark.parametrize("rows_a_range", [1, 7, 50, 10_000])
def test_running_sums(spark, rows_a_range):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else f"g{r.randrange(9)}", k * 3, r.choice((None, float(r.randint(-9, 9))))) for k in range(300)]
    dealt = prefix.ranges(spark.createDataFrame(rows, "g string, at bigint, v double").repartition(5), "g", "at", rows_a_range=rows_a_range)
    want, sums = {}, {}
    for g, at, v in rows:
        sums[g] = sums.get(g, 0.0) + (v or 0.0)
        want[g, at] = sums[g]
    got = {(x.g, x.at): (x.s, x.n) for x in dealt.running(dealt.rows, s=F.col("v"), n=F.lit(1.0)).collect()}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(want)
    assert max(n for (g, _), (_, n) in got.items() if g == "hot") == sum(g == "hot" for g, _, _ in rows)


def test_no_rows(spark):
    dealt = prefix.ranges(spark.createDataFrame([], "g string, at bigint, v double"), "g", "at")
    assert dealt.running(dealt.rows, s=F.col("v")).count() == 0


@pytest.mark.parametrize("hot_rows", [0, 3, 100])
def test_joined_hot(spark, hot_rows):
    big = spark.createDataFrame([(f"k{min(k, 4)}", k) for k in range(40)] + [("none", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([(f"k{k}", k * 10) for k in range(6)] + [(None, 7)], "k string, w int")
    got = sorted(map(tuple, prefix.joined_hot(big, small, "k", hot_rows).select("k", "v", "w").collect()))
    assert got == sorted((f"k{min(k, 4)}", k, min(k, 4) * 10) for k in range(40))


def test_a_million_files_of_one_name(spark):
    """Half a million files called index.ts, and as many that import them: ranges stay small, sums are right."""
    n = 1_000_000
    scored = spark.range(n).select(F.col("id").alias("scan_index"), (F.col("id") % 7 / 10).alias("score"))
    names = spark.range(n).select(F.col("id").alias("scan_index"), F.when(F.col("id") % 2 == 0, "index").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("base"))
    held = spark.range(1, n, 2).select(F.lit("index").alias("base"), F.col("id").alias("j"))
    sizes = []
    real = imports.ranges

    def watched(*args, **options):
        dealt = real(*args, **options)
        sizes.extend(r["count"] for r in dealt.rows.groupBy("range").count().collect())
        return dealt

    imports.ranges = watched
    try:
        found = imports.boost_in_order(scored, names, held, rows_a_range=50_000).where("scan_index % 2 = 0").agg(F.min("boost"), F.max("boost"), F.count("boost")).first()
    finally:
        imports.ranges = real
    total = sum(k % 7 for k in range(1, n, 2)) / 100
    assert found[0] == pytest.approx(total) and found[1] == pytest.approx(total) and found[2] == n // 2
    assert sum(sizes) == n and len(sizes) == 20 and max(sizes) < 2 * 50_000


def test_boost_in_order_over_many_ranges(spark):
    r = random.Random(6)
    n = 60
    scores = [r.uniform(-0.1, 1) for _ in range(n)]
    bases = ["index" if r.random() < 0.5 else f"b{r.randrange(8)}" for _ in range(n)]
    held = {("index", j) for j in range(0, n, 7)} | {(r.choice(bases), r.randrange(n)) for _ in range(60)}
    out = list(scores)
    for i in range(n):
        boost = sum(out[j] * 0.1 for b, j in held if b == bases[i])
        out[i] += boost if boost > 0 else 0
    tables = spark.createDataFrame(list(enumerate(scores)), "scan_index bigint, score double"), spark.createDataFrame(list(enumerate(bases)), "scan_index bigint, base string"), spark.createDataFrame(sorted(held), "base string, j bigint")
    got = imports.boost_in_order(*tables, rows_a_range=9).orderBy("scan_index").collect()
    assert [x.score + x.boost for x in got] == pytest.approx(out)
