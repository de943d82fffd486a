from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.toxicity import Automaton, Lexicon, Reader


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def run(auto: Automaton, words: list[str]) -> dict[str, tuple[int, int]]:
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    found, term, edits = auto.run(letters, ends - [len(w) for w in words], ends)
    return {words[k]: (t, e) for k, t, e in zip(found.tolist(), term.tolist(), edits.tolist())}


def test_automaton_against_edit_distances():
    r = random.Random(5)
    word = lambda a, b: "".join(r.choice("abcé") for _ in range(r.randint(a, b)))
    entries = [*{word(2, 8): None for _ in range(40)}]
    entries = [(e, k % 4 == 0, (k % 3) if len(e) > 3 else 0) for k, e in enumerate(entries)]
    words = [*{word(1, 10): None for _ in range(3000)}] + ["x", "aéx", "zzzz"]
    want = {}
    for w in words:
        best = []
        for k, (e, open_, most) in enumerate(entries):
            d = min(distance(w[:n], e) for n in range(len(w) + 1)) if open_ else distance(w, e)
            if d <= most:
                best.append((d, -len(e), k))
        if best:
            want[w] = (min(best)[2], min(best)[0])
    got = run(Automaton(entries), words)
    assert got.keys() == want.keys() and len(want) > 500
    # of several beginnings passed with as many edits the longer one counts, wherever it was passed
    assert {w: e for w, (_, e) in got.items()} == {w: e for w, (_, e) in want.items()}
    assert got == want


def test_an_automaton_of_nothing_accepts_nothing():
    assert run(Automaton([]), ["a", "bc"]) == {}


def counts(text: str | None, terms=(("idiot", False), ("disgusting", False), ("bomen", True))) -> dict:
    return dict(Reader(Lexicon(list(terms))).read(pa.array([text], pa.string()))[1][0])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("what an IDIOT!", {(0, False, False, False): 1}),
        ("what an idiiot, id10t", {(0, True, False, False): 1}),  # two edits are too many for five letters
        ("disgsting d1sgusting! disgustiing", {(1, True, False, False): 3}),
        ("bomenteta bomen bom", {(2, False, False, False): 2}),
        ("you idiot", {(0, False, False, True): 1}),
        ("he said idiot", {(0, False, True, False): 1}),
        ("“idiot” was read out", {(0, False, True, False): 1}),
        ('the "total idiot here" was read out', {(0, False, True, False): 1}),
        ('"hello" idiot "there"', {(0, False, False, False): 1}),
        ('"open ' + "far " * 20 + 'idiot" end', {(0, False, False, False): 1}),
        ("", {}),
        (None, {}),
    ],
)
def test_hits_and_what_surrounds_them(text, found):
    assert counts(text) == found


def test_windows_end_with_their_text():
    _, each = Reader(Lexicon([("idiot", False)])).read(pa.array(["you said", "idiot", "you said"]))
    assert [dict(c) for c in each] == [{}, {(0, False, False, False): 1}, {}]


def test_long_texts_in_pieces_are_as_whole_ones(monkeypatch):
    r = random.Random(8)
    text = " ".join(r.choice(("idiot", "you", "said", '"a', 'b"', "plain", "idi0t", "été", "x")) for _ in range(4000))
    whole = Reader(Lexicon([("idiot", False)])).read(pa.array(["z", text, "idiot"]))
    parts = toxicity.parts
    for size in (64, 500, 5000):
        monkeypatch.setattr(toxicity, "parts", lambda column, size=size: parts(column, size))
        n, each = Reader(Lexicon([("idiot", False)])).read(pa.array(["z", text, "idiot"]))
        assert n.tolist() == whole[0].tolist() == [1, 4000, 1]
        assert each == whole[1]


def labelled_tables(spark, n=600):
    r = random.Random(2)
    plain = lambda: " ".join("".join(r.choice(("an", "er", "th", "on", "re", "in")) for _ in range(r.randint(2, 5))) for _ in range(60))
    rows, labels = [], []
    for k in range(n):
        words, toxic = plain().split(), int(k % 5 == 0)
        if toxic:
            for w in r.sample(("gromble", "snotfaced", "wurzelkopf", "blatherskite"), 2):
                words.insert(r.randrange(60), w if k % 10 else w[:3] + "x" + w[4:])  # half of them misspelt
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents_and_misspelt_words(spark):
    docs, labels = labelled_tables(spark)
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [k for k in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(out) > 100
    toxic, clean = [rows[k].score for k in out if k % 5 == 0], [rows[k].score for k in out if k % 5]
    assert np.mean(np.array(toxic) >= toxicity.THRESHOLD) >= 0.95
    assert np.mean(np.array(clean) >= toxicity.THRESHOLD) <= 0.01
    told = toxicity.score(spark.createDataFrame([(1, "gromble you snotfaced"), (2, "they wrote 'gromble' and said 'snotfaced' there"), (3, "nothing")], "doc_id bigint, text string"), model)
    by = {r.doc_id: r for r in told.collect()}
    assert by[1].score > by[2].score > by[3].score * 0.99 and by[2].n_quoted == 2


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled_tables(spark, 200)
    held = toxicity.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert a.lexicon.terms == b.lexicon.terms and np.allclose(a.slopes, b.slopes)


def test_what_cannot_be_learned(spark):
    docs, labels = labelled_tables(spark, 40)
    for toxic, want in ((0, 0.0), (1, 1.0)):
        model = toxicity.train(docs, labels.withColumn("toxic", F.lit(toxic)))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {want}
    few = toxicity.train(docs, labels.where("toxic = 0 or doc_id in (5, 10)"))  # no word comes in three toxic documents
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, few).collect())


def test_a_regression_is_at_its_least():
    r = np.random.default_rng(4)
    x = np.c_[r.normal(size=(300, toxicity.FEATURES - 1)), np.ones(300)]
    y = (x[:, 0] - x[:, 2] + r.normal(size=300) > 1).astype(float)
    w = toxicity.regress(x, y)

    def loss(w):
        hold = np.r_[np.full(toxicity.FEATURES - 1, 0.5), 0.01]
        return (np.log1p(np.exp(x @ w)) - y * (x @ w)).sum() + 0.5 * (hold * (w - toxicity.PRIOR) ** 2).sum()

    for k in range(toxicity.FEATURES):
        for d in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + d * np.eye(toxicity.FEATURES)[k])


def test_edges(spark, edge_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(edge_docs, labels)
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
