from __future__ import annotations

import random

import pytest

LONG = " ".join(f"long{k % 977}" for k in range(120_000))
#: Names that operators use inside, as extra columns.
CLASHES = ("size", "target", "copies", "epochs", "_source", "_bucket", "_room", "source_size", "tail", "expected_grade", "fp", "_fp", "component_id", "root", "node", "_kept", "grade", "rules", "found", "kept", "language", "low", "high", "license", "digest", "lines", "start", "part", "block", "words", "doc", "item_id", "col")


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("an", "er", "th", "on", "re", "in")) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    r = random.Random(4)
    base = sentence(r, 120)
    return [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + " end", "en", "b", None),
        (4, None, "en", None, None),
        (5, "", None, "b", 0),
        (6, " \n\t ", "xx", None, 4),
        (7, "one", "fr", "c", 3),
        (8, LONG, "en", "a", len(LONG)),
        (None, "no id here", "de", "c", 10),
        (None, None, None, None, None),
        (9, "Été \U0001f600 你好 token=abcdefgh12 moron idiot", "fr", "c", 1),
        *[(100 + k, sentence(r, 80 + k), ("en", "de", "fr")[k % 3], ("a", "b", "c")[k % 3], 5) for k in range(20)],
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(edge_rows(), SCHEMA)
    return rows.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf(spark, edge_docs, tmp_path_factory):
    """A folder of tables, all of them edge cases."""
    d = str(tmp_path_factory.mktemp("sf"))
    edge_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (9, 1, 1), (100, None, None), (None, 1, 0), (999, 1, 0), (101, 1, 0), (101, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    text = edge_rows()[12][1]
    spark.createDataFrame([(0, " ".join(text.split()[10:40])), (1, None), (2, ""), (None, "three words only"), (0, "again the same number")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", "\\ </turn>"), (2, 0, "assistant", "\\ </turn>")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty_sf(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d
