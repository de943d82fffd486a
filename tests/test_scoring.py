from __future__ import annotations

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import scoring


def score(spark, path, content, question):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return df.select(scoring.basic_score(F.col("path"), F.col("content"), question)).first()[0]


def enhanced(spark, path, content, question, exports=None, symbols=None, lines=None):
    df = spark.createDataFrame([(path, content, exports, symbols, lines)], "path string, content string, exports array<string>, n int, loc int")
    r = df.select(scoring.enhanced_score(F.col("path"), F.col("content"), question, F.col("exports"), F.col("n"), F.col("loc")).alias("s")).first()["s"]
    return r["score"], r["reasons"]


@pytest.mark.parametrize(
    "path, content, question, want",
    [
        ("/path/to/file.ts", None, "test question", 0.0),
        ("/path/to/file.ts", "", "", 0.0),
        ("/src/authentication/auth-service.ts", "export class AuthService {}", "authentication", 0.3),
        ("/src/service.ts", "class S { login() {} logout() {} authenticate() {} }", "authentication login", 0.1 / 20),
        ("/path/to/file.ts", "content", "", 0.5),
        ("/path/to/file.ts", "content", "a an", 0.5),
        ("/src/user/profile.ts", "class P {}", "user profile settings", (3 + 5 + 3) / 30),
        ("/x/user.ts", "user " * 50, "user user", (2 * (5 + 3 + 2)) / 20),
        ("/x/a.ts", "sen sent send", "sent?", 0.3 / 10),
        ("/x/a.d.ts", "q", "a.d a.d.ts", (5 + 3 + 3) / 20),
    ],
)
def test_basic(spark, path, content, question, want):
    assert score(spark, path, content, question) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("word", ["c++", "(auth", "[x", "*ab", "ab**", "a(?i)b", "x\\Qy"])
def test_words_that_are_no_expressions(word):
    with pytest.raises(tx.BadWord):
        tx.checked_word(word)


def test_question_words(spark):
    q = "The  AN auth user　it abc sent? abc \U0001f600a \U0001f600"
    want = ["the", "auth", "user", "abc", "sent?", "abc", "\U0001f600a"]
    assert tx.words_of(q) == want
    assert spark.createDataFrame([(q,)], "q string").select(tx.question_words(F.col("q"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("écle cle xcle", 2), ("cle_ cle-cle", 2), ("", 0), ("CLE", 0)])
def test_word_edges_are_ascii(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.whole_word_count(F.col("t"), "cle")).first()[0] == want


@given(st.lists(st.tuples(st.text("ab_é9", min_size=1, max_size=5), st.text(" \n.,;:!?(){}[]<>'\"/\\|`~@#$%^&*+=- ", min_size=1, max_size=3)), max_size=8))
@settings(max_examples=15, deadline=None)
def test_token_count(spark, parts):
    text = "".join(a + b for a, b in parts)
    assert spark.createDataFrame([(text,)], "t string").select(tx.token_count(F.col("t"))).first()[0] == len(parts)


@pytest.mark.parametrize("x, want", [(1.45, "1.4"), (1.25, "1.3"), (1.05, "1.1"), (2.0, "2.0"), (9.95, "9.9"), (19.96, "20.0"), (8.35, "8.3"), (100 / 51, "2.0")])
def test_one_decimal(spark, x, want):
    from decimal import ROUND_HALF_UP, Decimal

    assert str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) == want or x == 1.05 and want == "1.1"
    assert spark.createDataFrame([(x,)], "x double").select(tx.one_decimal(F.col("x"))).first()[0] == want


def test_enhanced_stages(spark):
    s, reasons = enhanced(spark, "/app/user/user.ts", "user users USER\nuser_x", "user", ["getUser", "x"], 3, 100)
    want = 10 + 3 * 2 + math.log2(3) * 2 + 4 + 5 + 1
    assert s == pytest.approx(min(want / 23, 1))
    assert reasons == ['Exact filename match: "user"', 'Path contains: "user" (2 times)', 'Contains "user": 2 times', 'Exports symbols matching "user": getUser', "High symbol density: 3.0 symbols per 100 LOC", "Optimal file size"]


def test_enhanced_edges(spark):
    assert enhanced(spark, "/a/b.ts", "", "user") == (0.0, [])
    assert enhanced(spark, "/a/b.ts", "x", "of a") == (0.5, ["No meaningful keywords"])
    assert enhanced(spark, "/a/b.ts", "x", "user there", [], 0, 600) == (pytest.approx(-1 / 46), ["Large file - may need refinement"])
    assert enhanced(spark, "/a/users.ts", "user " * 40, "user")[0] == pytest.approx((5 + 3 + 10) / 23)
    # points of a recorded run: filename and path of one word among four, of two among five
    assert enhanced(spark, "/r/fetchMyKeys.ts", "q", "end-to-end encryption keys management")[0] == pytest.approx(8 / 92)
    assert enhanced(spark, "/r/FileUploadBase.ts", "q", "file upload and media handling")[0] == pytest.approx(16 / 115)


def test_ranks(spark):
    rows = [(0, "/b.ts", "auth"), (1, "/a.ts", "auth"), (2, "/A.ts", "auth"), (3, "/auth.ts", "x"), (4, "/z.ts", None)]
    corpus = spark.createDataFrame(rows, "scan_index bigint, path string, content string")
    assert [r["path"] for r in scoring.rank_basic(corpus, "auth", 4).collect()] == ["/auth.ts", "/a.ts", "/A.ts", "/b.ts"]
    assert scoring.rank_basic(corpus, "auth", 0).collect() == [] and scoring.rank_basic(corpus.limit(0), "auth").collect() == []
    with pytest.raises(ValueError):
        scoring.rank_basic(corpus, "auth", -1)


def test_many_questions_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(scoring, "QUESTIONS_A_PASS", 2)
    corpus = spark.createDataFrame([(0, "/auth.ts", "user"), (1, "/b.ts", "auth")], "scan_index bigint, path string, content string")
    asked = [("a", "auth"), ("b", "user"), ("c", "auth user")]
    got = {(r["query_id"], r["path"]): r["score"] for r in scoring.basic_scores(corpus, asked).collect()}
    assert len(got) == 6 and all(got[q, "/auth.ts"] == pytest.approx(score(spark, "/auth.ts", "user", t)) for q, t in asked)


def test_plan_keeps_few_rows(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("scan_index"), F.lit("p").alias("path"), F.col("text").alias("content"))
    plan = scoring.rank_basic(corpus, "auth")._jdf.queryExecution().toString()
    assert re.search("TakeOrderedAndProject", plan) and "Python" not in plan
