"""Scans, import graph, cache, whole questions, benchmark, tools, command line, server and stream over trees of files."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark import cli, server
from quillspark.functions.paths import normalized, relative, stem
from quillspark.operators import cache, imports, structure
from quillspark.plans import analysis, benchmark
from quillspark.sources import artefacts, code_tree
from quillspark.sources.scope import Module, Scope
from quillspark.streaming import incremental
from quillspark.tools import Toolbox

AUTH = "import { hash } from './hash';\nexport class AuthService {\n  login(user: string): boolean {\n    return hash(user) === 'x';\n  }\n}\n"
HASH = "export function hash(s: string): string {\n  return s + 'salt';\n}\n"
PERMIT = "import { AuthService } from './auth';\nexport const canAccess = (room: string): boolean => {\n  return new AuthService().login(room);\n};\n"


@pytest.fixture
def tree(tmp_path):
    app = tmp_path / "repo" / "apps" / "meteor"
    files = {
        ".meteor/keep.txt": "",
        "app/authorization/auth.ts": AUTH,
        "app/authorization/hash.ts": HASH,
        "app/authorization/permission.ts": PERMIT,
        "app/authorization/empty.ts": "",
        "app/authorization/_hidden.ts": "export const h = 1;\n",
        "app/authorization/.dot/x.tsx": "export const x = 1;\n",
        "app/authorization/types.d.ts": "declare const q: number;\n",
        "app/authorization/skip.js": "x",
        "app/authorization/UP.TS": "x",
        "app/authorization/node_modules/n.ts": "x",
        "app/authorization/dist/n.ts": "x",
        "app/lib/server/functions/test.ts": "// test file content",
        "non-allowed/ignored.ts": "// test file content",
    }
    for name, content in files.items():
        path = app / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (app / "app/authorization/bytes.ts").write_bytes(b"\xef\xbb\xbf// \xff\xfe\n")
    (app / "app/authorization/link.ts").symlink_to(app / "app/authorization/auth.ts")
    return str(tmp_path / "repo")


def names(df) -> list[str]:
    return [r["rel_path"] for r in df.orderBy("scan_index").collect()]


def test_scan_of_modules(spark, tree):
    a = "app/authorization/"
    kept = [a + x for x in (".dot/x.tsx", "_hidden.ts", "auth.ts", "bytes.ts", "empty.ts", "hash.ts", "permission.ts", "types.d.ts")]
    assert names(code_tree.scan_modules(spark, tree)) == ["app/lib/server/functions/test.ts", *kept]
    assert names(code_tree.scan_modules(spark, tree, ["authorization", "nothing"])) == kept
    assert names(code_tree.scan_modules(spark, tree, ["authorization", "lib-server-functions"]))[0] == "app/lib/server/functions/test.ts"
    with pytest.raises(ValueError):
        code_tree.scan_modules(spark, tree, ["nothing"])


def test_scan_of_a_tree(spark, tree, tmp_path):
    found = code_tree.scan(spark, f"{tree}/apps/meteor")
    assert "non-allowed/ignored.ts" in names(found) and names(found) == [p[len(tree) + 13 :] for p, _ in code_tree.walk(f"{tree}/apps/meteor")]
    assert found.where("rel_path LIKE '%bytes.ts'").first()["content"] == "﻿// ��\n"
    assert code_tree.scan(spark, str(tmp_path / "missing")).count() == 0
    inner = tmp_path / "dist"
    inner.mkdir()
    (inner / "a.ts").write_text("x")
    assert names(code_tree.scan(spark, str(inner))) == ["a.ts"]  # the root's own name doesn't matter


def test_root(tree, tmp_path, monkeypatch):
    scope = Scope()
    assert scope.resolve_root(tree) == f"{tree}/apps/meteor" == scope.resolve_root(f"{tree}/apps/meteor")
    assert scope.resolve_root(str(tmp_path)) == str(tmp_path) and not scope.is_root(str(tmp_path))
    with pytest.warns(UserWarning):
        scope.warn_unless_root(str(tmp_path))


@pytest.mark.parametrize("a, b", [("/a/./b/../c", "/a/c"), ("a/../../b", "../b"), ("../x/..", ".."), ("", ""), ("/a//b/", "/a/b")])
def test_normalized(spark, a, b):
    assert spark.range(1).select(normalized(F.lit(a))).first()[0] == b


@pytest.mark.parametrize("path, root, want", [("/r/a/b.ts", "/r", "a/b.ts"), ("/r/a", "/r/b/c", "../../a"), ("/rx/a", "/r", "../rx/a"), ("a", "", "a"), ("/r", "/r", "")])
def test_relative(spark, path, root, want):
    assert spark.range(1).select(relative(F.lit(path), root)).first()[0] == want


@pytest.mark.parametrize("path, want", [("/a/x.d.ts", "x.d"), (".env", ".env"), ("/a/b", "b"), ("a.b/c.tsx", "c")])
def test_stem(spark, path, want):
    assert spark.range(1).select(stem(F.lit(path))).first()[0] == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("import a from 'a'\nimport b from 'b'\nimport {c} from 'c'", ["c"]),
        ("import a from 'a';\nimport {\n b,\n c } from \"../b\";\nimport * as d from './d';", ["a", "../b", "./d"]),
        ("import './side';\nimport x from 'x';", ["x"]),
        ("import './side'\nimport x from 'x'", ["x"]),
        ("import type { T } from 't';\nexport { y } from 'y';\n// import z from 'z';", ["t", "z"]),
        ("", []),
    ],
)
def test_specifiers(spark, source, want):
    assert spark.createDataFrame([(source,)], "s string").select(imports.specifiers(F.col("s"))).first()[0] == want


def fold(scores: list[float], pairs: set) -> list[float]:
    """The boost by one ordered pass in place."""
    out = list(scores)
    for i in range(len(out)):
        boost = sum(out[j] * 0.1 for j in range(len(out)) if (i, j) in pairs)
        out[i] += boost if boost > 0 else 0
    return out


def test_boost_in_order(spark):
    import random

    r = random.Random(3)
    for n in (6, 15):
        scores = [r.uniform(-0.1, 1) for _ in range(n)]
        bases = [f"b{r.randrange(max(2, n // 2))}" for _ in range(n)]  # files share names
        held = {(r.choice(bases), r.randrange(n)) for _ in range(2 * n)}
        pairs = {(i, j) for b, j in held for i in range(n) if bases[i] == b}
        scored = spark.createDataFrame(list(enumerate(scores)), "scan_index bigint, score double")
        names = spark.createDataFrame(list(enumerate(bases)), "scan_index bigint, base string")
        links = spark.createDataFrame(sorted(held), "base string, j bigint")
        got = [r["score"] + r["boost"] for r in imports.boost_in_order(scored, names, links).orderBy("scan_index").collect()]
        assert got == pytest.approx(fold(scores, pairs))
        at_once = [r["boost"] for r in imports.boost_at_once(scored, names, links).orderBy("scan_index").collect()]
        assert at_once == pytest.approx([max(0, sum(0.1 * scores[j] for a, j in pairs if a == i)) for i in range(n)])


def test_importers(spark):
    rows = [(0, "/r/n_1.ts", "import a from './n_10';"), (1, "/r/n_10.ts", "import q from 'lib/n_1x';"), (2, "/r/Foo.tsx", "import f from './Foo';"), (3, "/r/Foo.ts", "import f from './Foo';")]
    corpus = spark.createDataFrame(rows, "scan_index bigint, path string, content string")
    got = {(r["i"], r["j"]) for r in imports.importers(corpus, "/r").collect()}
    base = ["n_1", "n_10", "Foo.tsx", "Foo"]
    deps = [["n_10"], ["lib/n_1x"], ["Foo"], ["Foo"]]
    assert got == {(i, j) for i in range(4) for j in range(4) if any(base[i] in d for d in deps[j])}


def test_path_rules_agree_with_the_walk(spark, tree):
    """The rules as Columns pass the files that a walk finds, of all that are there."""
    import os

    from quillspark.functions.paths import is_below, is_source
    from quillspark.sources.scope import IGNORED, SUFFIXES

    root = f"{tree}/apps/meteor"
    there = [os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not os.path.islink(os.path.join(d, f))]
    rows = spark.createDataFrame([(p,) for p in there], "path string")
    got = {r["path"] for r in rows.where(is_source(F.col("path"), SUFFIXES) & ~is_below(F.col("path"), IGNORED)).collect()}
    assert got == {os.path.relpath(p, root) for p, _ in code_tree.walk(root)} and len(there) > len(got)


def test_scoped_corpus(spark):
    scope = Scope(modules=(Module("a", "x/a"), Module("b", "x/a/b"), Module("c", "y")))
    corpus = spark.createDataFrame([(0, "x/a/f.ts", ""), (1, "x/a/b/g.ts", ""), (2, "x/ab/h.ts", ""), (3, "y/i.ts", "")], "scan_index bigint, path string, content string")
    found = [(r["module"], r["scan_index"]) for r in code_tree.scoped(corpus, scope, ["b", "a"]).collect()]
    assert sorted(found) == [("a", 0), ("a", 1), ("b", 1)]


def test_plain_words_are_counted_as_expressions(spark):
    from quillspark.functions import text as tx

    rows = spark.createDataFrame([("aaaa a-a it's \u00e9t\u00e9 aaa",), ("",), (None,)], "t string")
    for word in ("aa", "a-a", "it's", "\u00e9t\u00e9"):
        got = [r[0] for r in rows.select(tx.match_count(F.col("t"), word)).collect()]
        assert got == [r[0] for r in rows.select(F.regexp_count("t", F.lit(word))).collect()]


def test_cache(spark, tree, tmp_path):
    held = cache.ResultCache(spark, str(tmp_path / "cache"))
    corpus = code_tree.scan_modules(spark, tree)
    result = spark.createDataFrame([("a", 0.5)], "path string, score double")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert held.get("0" * 32, corpus, now) is None
    held.set("0" * 32, result, corpus, now)
    assert held.get("0" * 32, corpus, now).collect() == result.collect()
    held.clear_memory()
    assert held.get("0" * 32, corpus, now + timedelta(hours=23)).collect() == result.collect()
    assert held.get("0" * 32, corpus, now + timedelta(hours=25)) is None
    path = f"{tree}/apps/meteor/app/authorization/hash.ts"
    for change in (lambda: open(path, "a").write("x"), lambda: os.remove(path), lambda: open(path + "x.ts", "w").write("y")):
        held.set("0" * 32, result, code_tree.scan_modules(spark, tree), now)
        change()
        assert held.get("0" * 32, code_tree.scan_modules(spark, tree), now) is None
    s = held.stats()
    assert (s["hits"], s["misses"], s["invalidations"], s["hitRate"]) == (2, 5, 4, 0.29) and s["cacheSize"] > 0
    held.clear()
    assert held.stats()["cacheSize"] == 0


def test_cache_keys(spark):
    key = cache.cache_key("/r", "q", ["a", "b"], True, 10)
    assert key != cache.cache_key("/r", "q", ["b", "a"], True, 10) and key != cache.cache_key("/r", "q", ["a", "b"], True, 10, mapping=True)
    df = spark.range(1).select(cache.cache_key_of(F.lit("/r"), F.lit("q"), F.lit("a,b"), F.lit(True), F.lit(10)))
    assert df.first()[0] == key


@pytest.mark.parametrize("enhanced", [False, True])
def test_analyze(spark, tree, tmp_path, enhanced):
    held = cache.ResultCache(spark, str(tmp_path / "cache"))
    options = analysis.Options(tree, "permission access auth", 3, generate_mapping=True, enhanced_ranking=enhanced, module_keys=["authorization"])
    rows = analysis.analyze(spark, options, held).collect()
    assert [r["path"] for r in rows][0] in ("app/authorization/permission.ts", "app/authorization/auth.ts") and 1 <= len(rows) <= 3
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    auth = next(r for r in rows if r["path"].endswith("auth.ts"))
    assert "[SYMBOL:AuthService.login]" in auth["skeleton"] and auth["original_token_count"] == 15
    mapping = json.load(open(f"{tree}/apps/meteor/{analysis.MAPPING_FILE}"))
    assert mapping["files"]["app/authorization/auth.ts"]["symbols"][0]["symbolId"] == "AuthService.login"
    again = analysis.analyze(spark, options, held).collect()
    assert held.hits == 1 and [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_analyze_nothing(spark, tmp_path):
    with pytest.warns(UserWarning):
        found = analysis.analyze(spark, analysis.Options(str(tmp_path), "x"))
    assert found.collect() == [] and found.columns == ["path", "score", "skeleton", "original_token_count", "skeleton_token_count"]


def test_mapping_round_trip(spark, tree, tmp_path):
    corpus = code_tree.scan_modules(spark, tree)
    root = f"{tree}/apps/meteor"
    table = structure.symbols(structure.parsed(corpus), root)
    path = str(tmp_path / "m.json")
    artefacts.save_mapping(table, path, root, datetime(2024, 1, 2, tzinfo=UTC))
    assert json.load(open(path))["generatedAt"] == "2024-01-02T00:00:00.000Z"
    back = artefacts.load_mapping(spark, path)
    columns = [c for c in table.columns if c not in ("file_order", "symbol_order")]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, table.select(columns).collect()))
    artefacts.save_mapping(table.limit(0), path, root)
    assert json.load(open(path))["files"] == {} and artefacts.load_mapping(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        artefacts.load_mapping(spark, str(tmp_path / "none.json"))


def test_tools(spark, tree):
    corpus = code_tree.scan_modules(spark, tree)
    box = Toolbox(spark, corpus, f"{tree}/apps/meteor")
    assert "error" in box.call("search_symbols", {"query": "x"}) and box.stats()["symbols"] == 0
    box.symbols = structure.symbols(structure.parsed(corpus), box.root).persist()
    found = box.call("get_symbol_details", {"symbolId": "AuthService.login"})
    assert found["content"].startswith("  login(user: string)") and found["location"]["parentClass"] == "AuthService"
    assert "error" in box.call("get_symbol_details", {"symbolId": "none"}) and "error" in box.call("other", {})
    assert box.call("search_symbols", {"query": "AUTH"})["count"] >= 2
    assert box.call("analyze_file_dependencies", {"filePath": "app/authorization/permission.ts"})["imports"] == ["./auth"]
    assert "error" in box.call("analyze_file_dependencies", {"filePath": "none.ts"})
    assert box.stats()["byType"] == {"method": 1, "function": 1, "arrow-function": 1}
    answers = iter([{"calls": [{"name": "search_symbols", "arguments": {"query": "login"}}]}, {"text": "done"}])
    box.model = lambda messages, tools: next(answers)
    assert box.chat("?") == "done"
    lines, said = iter(["stats", "search hash", "what", "exit"]), []
    cli.repl(box, lambda _: next(lines), said.append)
    assert json.loads(said[1])["count"] >= 1 and len(said) == 3


def test_benchmark(spark, tree):
    assert {s.module_key for s in benchmark.SCENARIOS} <= {m.key for m in Scope().modules}
    r = benchmark.run_scenario(spark, tree, benchmark.Scenario("authorization", "auth permission", 2))
    assert r["allFilesCount"] == 8 and r["analyzedFileCount"] == 2 and r["analyzedOriginalTokens"] == sum(f["originalTokens"] for f in r["topFiles"])
    assert "authorization" in benchmark.report([r]) and benchmark.summary([])["averageExecutionTimeMs"] is None
    with pytest.raises(ValueError):
        benchmark.run_scenario(spark, tree, benchmark.Scenario("none", "q"))
    corpus = spark.createDataFrame([(k, "p", "a b c" if k else None) for k in range(10)], "scan_index bigint, path string, content string")
    assert tuple(benchmark.sampled_tokens(corpus, 4).first()) == (10, 23, True)  # 9 tokens of 4 files: 22.5, rounded up
    assert tuple(benchmark.sampled_tokens(corpus, 50).first()) == (10, 27, False)


def test_command_line(spark, tree, capsys, tmp_path):
    more = ["--root", tree, "--cache-dir", str(tmp_path / "c")]
    assert cli.main(["--question", "auth", "--limit", "2", "--modules", "authorization", *more]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["limit"] == 2 and out["files"][0]["path"] == "app/authorization/auth.ts" and "originalTokenCount" in out["files"][0]
    assert cli.main([*more]) == 1 and cli.main(["--clear-cache", "--cache-stats", *more]) == 0
    assert cli.main(["--question", "x", "--modules", "none", *more]) == 1
    with pytest.raises(SystemExit):
        cli.main(["--question", "x", "--limit", "0"])


def test_server(spark, tree):
    ask = lambda k, method, **params: json.dumps({"jsonrpc": "2.0", "id": k, "method": method, "params": params})
    lines = [ask(1, "initialize"), ask(2, "tools/list"), ask(3, "tools/call", name="scan_codebase", arguments={"question": "auth", "root": tree, "limit": 1}), ask(4, "tools/call", name="other"), '{"jsonrpc": "2.0", "method": "notifications/initialized"}']
    got = [json.loads(x) for x in server.serve(spark, lines)]
    assert [x["id"] for x in got] == [1, 2, 3, 4] and got[1]["result"]["tools"][0]["name"] == "scan_codebase"
    assert json.loads(got[2]["result"]["content"][0]["text"])["files"][0]["path"].endswith("auth.ts") and "Unknown tool" in got[3]["error"]["message"]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(0, "/auth.ts", "user"), (1, "/b.ts", None)]
    spark.createDataFrame(rows, "scan_index bigint, path string, content string").write.parquet(source)
    stream = spark.readStream.schema("scan_index bigint, path string, content string").parquet(source)
    q = incremental.write_scores(stream, "auth", str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = {r["path"]: (r["score"], r["token_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"/auth.ts": (0.8, 1), "/b.ts": (0.0, 0)}


def test_own_registry(spark, tmp_path):
    (tmp_path / "src/x").mkdir(parents=True)
    (tmp_path / "src/x/a.ts").write_text("export const a = 1;")
    scope = Scope(app_path="src", marker="x", modules=(Module("x", "x"),))
    assert names(code_tree.scan_modules(spark, str(tmp_path), scope=scope)) == ["x/a.ts"]


def test_a_mapping_is_written_whole_or_not(spark, tmp_path):
    """Ranges of files by tasks, in order; a task that fails leaves the old file and nothing beside it."""
    rows = [(k, j, f"s{k}.{j}", "n", "method", f"f{k:03}.ts", 1, 2, None, None, None, 'say "é"\n') for k in range(200) for j in range(k % 3)]
    names_ = "file_order bigint, symbol_order int, symbol_id string, symbol_name string, symbol_type string, file_path string, start_line int, end_line int, start_pos int, end_pos int, parent_class string, signature string"
    path = tmp_path / "m.json"
    table = spark.createDataFrame(rows, names_).repartition(5)
    artefacts.save_mapping(table, str(path), "/r")
    whole = json.loads(path.read_text())
    assert list(whole["files"]) == [f"f{k:03}.ts" for k in range(200) if k % 3]
    assert [s["symbolId"] for s in whole["files"]["f005.ts"]["symbols"]] == ["s5.0", "s5.1"] and whole["files"]["f005.ts"]["originalPath"] == "/r/f005.ts"
    before = path.read_text()
    with pytest.raises(Exception, match="path"):  # a name that is null can't be joined to the root
        artefacts.save_mapping(table.withColumn("file_path", F.when(F.col("file_order") != 100, F.col("file_path"))), str(path), "/r")
    assert path.read_text() == before and os.listdir(tmp_path) == ["m.json"]
    artefacts.save_mapping(table.limit(0), str(path), "/r")
    assert json.loads(path.read_text())["files"] == {}
