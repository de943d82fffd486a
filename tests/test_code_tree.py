"""Trees listed by tasks against one walk, and how few files a question opens."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.plans import benchmark
from quillspark.sources import code_tree
from quillspark.sources.scope import Module, Scope


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    r, root = random.Random(4), tmp_path_factory.mktemp("tree")
    names = ["a", "a.b", "a-b", "A", "é", "a b", "zz", "node_modules", "dist", ".x", "_y", "a.ts"]
    folders = [root]
    for _ in range(60):
        f = r.choice(folders) / r.choice(names)
        if not f.exists():
            f.mkdir()
            folders.append(f)
    for k in range(300):
        f = r.choice(folders) / (r.choice(names) + r.choice((".ts", ".tsx", ".js", "0.ts", "")) + r.choice(("", ".ts")))
        if not f.exists():
            f.write_text(f"const v{k} = {k};\n")
    os.symlink(root / "a", root / "link")
    (root / "gone").mkdir(mode=0)
    return str(root)


@pytest.mark.parametrize("entries", [1, 5, 40, 20_000])
def test_order_is_that_of_the_walk(spark, tree, entries):
    got = code_tree.scan(spark, tree, entries).orderBy("scan_index").collect()
    want = [p for p, _ in code_tree.walk(tree)]
    assert [r.path for r in got] == want and len(want) > 100
    assert [r.scan_index for r in got] == list(range(len(want)))
    assert [r.rel_path for r in got] == [os.path.relpath(p, tree) for p in want]
    assert [r.content for r in got] == [open(p, encoding="utf-8").read() for p in want]


def test_modules_in_order_and_twice(spark, tree):
    scope = Scope(app_path="", marker=".none", modules=(Module("z", "a"), Module("all", ""), Module("missing", "nowhere")))
    got = code_tree.scan_modules(spark, tree, scope=scope).orderBy("scan_index").collect()
    inner, whole = ([p for p, _ in code_tree.walk(os.path.join(tree, x) if x else tree + "/")] for x in ("a", ""))
    assert [(r.module, os.path.normpath(r.path)) for r in got] == [("z", p) for p in inner] + [("all", os.path.normpath(p)) for p in whole]


def test_names_that_are_no_text(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff.ts"), "w") as f:
        f.write("const x = 1;")
    row = code_tree.scan(spark, str(tmp_path)).first()
    assert row.rel_path == "bad�.ts" and row.content == "const x = 1;"


def test_only_files_that_are_asked_for_are_opened(spark, tmp_path):
    for k in range(120):
        (tmp_path / f"f{k:03}.ts").write_text(f"x {k}")
    corpus = code_tree.scan(spark, str(tmp_path))

    def opened(df):
        for k in range(120):
            os.utime(tmp_path / f"f{k:03}.ts", (1, 1e9))
        out = df.collect()
        return sum(os.stat(tmp_path / f"f{k:03}.ts").st_atime > 1 for k in range(120)), out

    if opened(corpus)[0] != 120:
        pytest.skip("this file system doesn't tell when files are read")
    assert opened(corpus.select("path", "scan_index"))[0] == 0
    assert opened(corpus.where("scan_index < 50"))[0] == 50
    assert opened(corpus.where(F.col("path").endswith("7.ts")))[0] == 12
    n, found = opened(benchmark.sampled_tokens(corpus, 50))
    assert n == 50 and tuple(found[0]) == (120, 240, True)


def test_a_tree_is_written_whole_or_not(spark, tmp_path):
    rows = [("a/b.ts", "é"), ("a/../c.ts", "x"), ("d.ts", None), (None, "x"), ("empty.ts", "")]
    code_tree.write_tree(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "t"))
    found = {r.rel_path: r.content for r in code_tree.scan(spark, str(tmp_path / "t")).collect()}
    assert found == {"a/b.ts": "é", "c.ts": "x", "empty.ts": ""}
    with pytest.raises(Exception, match="leads out"):
        code_tree.write_tree(spark.createDataFrame([("../x.ts", "x")], "path string, content string"), str(tmp_path / "t"))
    assert not (tmp_path / "x.ts").exists()
    spark.createDataFrame([], "path string, content string").transform(lambda e: code_tree.write_tree(e, str(tmp_path / "none")) or e)
    assert code_tree.scan(spark, str(tmp_path / "none")).count() == 0


def test_numbers_over_many_ranges(spark):
    from quillspark.operators.prefix import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = numbered(rows, "k", "v", rows_a_range=37).collect()
    assert sorted((r.v, r.k) for r in got) == [(k, k) for k in range(1000)]
