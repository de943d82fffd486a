from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quillspark.llm import licenses

MIT = licenses._PERMIT


@pytest.mark.parametrize(
    "text, license, notices, n",
    [
        ("MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + MIT.upper().replace("SUBLICENSE", "sub-licence".replace("-", "")), "MIT", "", 0),
        (MIT.replace("\n", "\n\n").replace(",", " ,"), "MIT", "", 0),
        (MIT + "\nand more", None, "", 0),
        ("some text\nReleased under the MIT licence\nmore\nreleased, under the MIT License!!", None, "MIT", 2),
        ("Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", None, "Apache-2.0,CC-BY-NC-4.0", 2),
        ("", None, "", 0),
        (None, None, "", 0),
    ],
)
def test_texts_and_notices(spark, text, license, notices, n):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(x["license"], x["notices"], x["n_notices"]) for x in r] == [(license, notices, n)]


@pytest.mark.parametrize("name, license", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_licence_files(spark, name, license):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence files on this machine")
    text = path.read_text()
    head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    rows = [(1, text), (2, head + end), (3, text[: len(text) // 2])]
    found = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: license, 2: license, 3: None}


@pytest.mark.parametrize(
    "line, license",
    [
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Distributed under the GNU Lesser General Public Licence, version 2.1", "LGPL-2.1"),
        ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
    ],
)
def test_more_notices(spark, line, license):
    r = licenses.scan(spark.createDataFrame([(1, "some text\n" + line)], "doc_id bigint, text string")).first()
    assert (r["notices"], r["n_notices"]) == (license, 1)


def test_a_digest_names_one_licence(spark):
    rows = licenses.known(spark).collect()
    assert len({(r["unit"], bytes(r["digest"])) for r in rows}) == len(rows)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    want = con.sql(licenses.ORACLE_SQL)
    got = licenses.op8(spark, sf).select(*want.columns).collect()
    assert key(got) == key(want.fetchall())


def test_no_python_on_the_main_path(spark, sf):
    plan = licenses.op8(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_knows_the_same_licences(spark):
    """Every text and notice of the table, and whole licence files, by the operator and by its SQL."""
    files = sorted(Path("/usr/share/common-licenses").glob("*")) if Path("/usr/share/common-licenses").exists() else []
    texts = [t for _, t in (*licenses.TEXTS, *licenses.NOTICES, *licenses.MORE_NOTICES)] + [f.read_text(errors="replace") for f in files] + [None, "", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(licenses.ORACLE_SQL)
    columns = sorted(want.columns)
    got = sorted(map(repr, map(tuple, licenses.scan(docs).select(*columns).collect())))
    assert got == sorted(map(repr, want.select(*columns).fetchall()))
    assert sum("None" not in r for r in got) >= len(licenses.TEXTS)
