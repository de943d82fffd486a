from __future__ import annotations

import math

import numpy as np

from quillspark.llm import ordinal


def corpus(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    r = np.random.default_rng(seed)
    parts = ["an", "er", "th", "on", "re", "in"]
    texts, grades = [], []
    for _ in range(n):
        words = ["".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(60, 300))]
        grade = int(r.integers(0, 3))
        if grade == 0:
            for w in r.choice(["vile", "rotten", "nasty", "awful"], 3):
                words.insert(r.integers(0, len(words)), w)
        if grade == 1:
            words = [w + "###" for w in words]
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, np.array(grades)


def test_held_out_accuracy():
    texts, grades = corpus(900, 1)
    rows = [ordinal.features(t) for t in texts]
    model = ordinal.fit(np.concatenate(rows[:600]), np.array([len(x) for x in rows[:600]]), grades[:600])
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array([model.weights[x].sum(dtype=float) for x in rows[600:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 1] >= 0.5) == (grades[600:] == 2)).mean() > 0.93


def test_held_out_on_labels(spark):
    """Fitted on half of the labels of sf0.1, held against the other half."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = ordinal.train(docs, labels.where("doc_id % 2 = 0"))
    found = ordinal.score(docs, model).join(ordinal.graded(labels).where("doc_id % 2 = 1"), "doc_id").select("grade", "tail").toPandas()
    kept = found["tail"] >= 0.5
    assert kept[found.grade == 2].mean() > 0.93 and kept[found.grade < 2].mean() < 0.12


def test_one_grade_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert ordinal.select(docs, labels).count() == 2


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.graded(labels).collect()} == {1: 1, 2: 0, 3: 2}


def brute_fit(rows: list[set], grades: list[int], steps: int, rate: float = 0.1, sparse: float = 3e-4, least_rows: int = 4) -> tuple[dict, list[float]]:
    """The same descent by plain loops over documents and slots."""
    count: dict = {}
    for r in rows:
        for s in r:
            count[s] = count.get(s, 0) + 1
    names = sorted(s for s, n in count.items() if n >= least_rows)
    w, cut = {s: 0.0 for s in names}, [-1.0, math.log(2.0)]
    m, v = ({k: 0.0 for k in [*names, "a", "b"]} for _ in range(2))
    sig = lambda z: 1 / (1 + math.exp(-z))
    weight = [math.sqrt(len(grades) / (len(set(grades)) * grades.count(g))) for g in grades]
    for step in range(1, steps + 1):
        g = {k: 0.0 for k in m}
        low, high = cut[0], cut[0] + math.exp(cut[1])
        for r, grade, b in zip(rows, grades, weight):
            z = sum(w[s] for s in r if s in w)
            t0, t1 = sig(z - low), sig(z - high)
            p = (1 - t0, t0 - t1, t1)[grade]
            d0 = (-t0 * (1 - t0), t0 * (1 - t0), 0.0)[grade]
            d1 = (0.0, -t1 * (1 - t1), t1 * (1 - t1))[grade]
            k = -b / max(p, 1e-9) / len(rows)
            for s in r:
                if s in w:
                    g[s] += k * (d0 + d1)
            g["a"] -= k * (d0 + d1)
            g["b"] -= k * d1 * math.exp(cut[1])
        for k in m:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            pace = rate / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-4)
            move = pace * m[k] / (1 - 0.9**step)
            if k == "a":
                cut[0] -= move
            elif k == "b":
                cut[1] -= move
            else:
                w[k] -= move
                if k < 1 << ordinal.BITS:
                    w[k] = math.copysign(max(abs(w[k]) - pace * sparse, 0.0), w[k])
    return w, [cut[0], cut[0] + math.exp(cut[1])]


def test_fit_by_plain_loops():
    texts, grades = corpus(40, 4)
    rows = [ordinal.features(t) for t in texts]
    model = ordinal.fit(np.concatenate(rows), np.array([len(x) for x in rows]), grades, steps=25)
    w, cut = brute_fit([set(x.tolist()) for x in rows], grades.tolist(), 25)
    assert np.allclose(model.thresholds, cut, atol=1e-6)
    assert np.allclose([model.weights[s] for s in w], list(w.values()), atol=1e-5)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(w)


def test_repeated_rows_and_bounds(spark):
    """Repeated rows neither crowd others out nor weigh more; the bound on entries takes the least telling slots."""
    texts, grades = corpus(60, 6)
    labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k, g in enumerate(grades.tolist())], "doc_id bigint, quality int, toxic int")
    once = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, slots string")
    often = once.unionAll(once.where("doc_id < 5")).unionAll(once.where("doc_id < 5")).unionAll(once.where("doc_id < 5"))
    a, b = ordinal.train(once, labels), ordinal.train(often, labels)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
    few = ordinal.train(once, labels, max_slots=sum(len(ordinal.features(t)) for t in texts) // 2)
    assert not np.array_equal(a.weights, few.weights) and len(few.thresholds) == 2
    assert np.count_nonzero(few.weights) < np.count_nonzero(a.weights)
    none = ordinal.train(once, labels, max_slots=0)  # no words, but the grades' shares
    assert len(none.thresholds) == 2 and not none.weights.any()


def test_the_most_telling_slots_stay(spark):
    rows = [(k, k % 2 * 2, [1, 2, 3] if k % 2 else [2, 4] if k % 4 else [2, 3, 5]) for k in range(16)]
    frame = spark.createDataFrame([(k, k, g, len(s), s) for k, g, s in rows], "h bigint, doc_id bigint, grade int, n bigint, slots array<int>")
    kept = lambda most: {tuple(r.slots) for r in ordinal.narrowed(frame, most).collect()}
    assert kept(8) == {(1,), ()}  # says all
    assert kept(20) == {(1, 3), (3,), ()}  # 3 has twelve rows; 4 and 5 have four each and would fit, but 3 comes first
    assert kept(28) == {(1, 3), (3, 5), (4,)}
    assert kept(0) == {()}


def test_one_document_of_very_many_words(spark, tmp_path):
    """It is longer than the bound, and the first by the seeded hash; the others are learned from all the same."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts, grades = corpus(60, 6)
    first = min(range(60), key=lambda k: spark.sql(f"SELECT xxhash64(5, {k}L)").first()[0])
    texts[first] = " ".join(f"w{k}" for k in range(300_000)) + " ###" * 10
    pq.write_table(pa.table({"doc_id": range(60), "text": texts}), f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k, g in enumerate(grades.tolist())], "doc_id bigint, quality int, toxic int")
    model = ordinal.train(docs, labels, max_slots=8000)
    tails = {r.doc_id: r.tail for r in ordinal.score(docs, model).collect()}
    right = sum((tails[k] >= 0.5) == (grades[k] == 2) for k in range(60) if k != first)
    assert len(model.thresholds) == 2 and right >= 55


def test_a_tie_is_kept(spark, monkeypatch):
    model = ordinal.Model(np.zeros((1 << ordinal.BITS) + ordinal.SHAPES, np.float32), np.array([-1.0, 0.0]))
    monkeypatch.setattr(ordinal, "train", lambda *a, **k: model)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ordinal.score(docs, model).first()["tail"] == 0.5 and ordinal.select(docs, docs).count() == 1
