from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash
from quillspark.llm.simhash import block_masks, components, fingerprint, forest, links, shingle_hashes


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints: list[int], radius: int = 4) -> list[int]:
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(prints))]


def clustered(n: int, seed: int) -> list[int]:
    """Fingerprints in groups: some tight, some chained, some alone."""
    r = random.Random(seed)
    out: set[int] = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 3, 40))):
            out.add(x)
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("text", ["a b c d e", "A b  C\nD e f g", "one", "", None, "É é A B c", "x " * 5000])
def test_fingerprint(text):
    assert fingerprint(shingle_hashes(text or "")) % (1 << 64) == brute_print(text)


def test_forest_spans_what_links():
    prints = clustered(300, 1)
    pairs = forest(np.array(prints, np.uint64), np.full(len(prints), -1))
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        assert (prints[a] ^ prints[b]).bit_count() <= 4
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert [find(k) for k in range(len(prints))] == brute_roots(prints)
    assert len(pairs) < len(prints)


@pytest.mark.parametrize("rows", [4096, 16])
def test_links_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "FILE_ROWS", rows)  # 16: files are split, and pairs of parts meet
    prints = clustered(500, 2)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = components(links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()
    root = {r["node"]: r["root"] for r in found}
    groups: dict = {}
    for x in signed:
        groups.setdefault(root.get(x, x), set()).add(x)
    want: dict = {}
    for k, r in enumerate(brute_roots(prints)):
        want.setdefault(r, set()).add(signed[k])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_every_pair_shares_a_file(blocks):
    r = random.Random(blocks)
    masks = block_masks(blocks)
    for _ in range(300):
        x = y = r.getrandbits(64)
        for _ in range(4):
            y ^= 1 << r.randrange(64)
        assert any(x & m == y & m for m in masks)


def test_op7(spark, sf):
    found = simhash.op7(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {(-1 if r[0] is None else r[0], r[1]): brute_print(r[1]) for r in docs if len(r[1] or "") < 5000}
    got = {(-1 if i != i else int(i)): f for i, f in zip(found.doc_id, found.fingerprint)}
    for (doc_id, _), p in prints.items():
        if doc_id >= 0:
            assert got[doc_id] == format(p, "016x")
    rows = [(i, int(f, 16)) for i, f in zip(found.doc_id, found.fingerprint)]
    roots = brute_roots([p for _, p in rows])
    least: dict = {}
    for (i, _), r in zip(rows, roots):
        if i == i:
            least[r] = min(least.get(r, i), i)
    assert [(c if c == c else None) for c in found.component_id] == [least.get(r) for r in roots]


@pytest.mark.parametrize("small", [0, 64])
def test_small_files_span_what_links(monkeypatch, small):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(7)
    rows = [(f, -1 if f % 2 else r.randrange(2), x - (1 << 64) if x >> 63 else x) for f in range(30) for x in clustered(r.randint(1, 40), f)]
    frames = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[a : a + 37]], pa.int64()) for k in range(3)], names=["file", "part", "fp"]) for a in range(0, len(rows), 37)]
    got = [(a, b) for f in simhash._file_links(4)(iter(frames)) for a, b in zip(f.column(0).to_pylist(), f.column(1).to_pylist())]
    bits = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert all(bits(a, b) <= 4 for a, b in got) and len(got) < len(rows)
    own, want = simhash.Roots(), simhash.Roots()
    for a, b in got:
        own.link(a, b)
    for k, (f, p, x) in enumerate(rows):
        for g, q, y in rows[:k]:
            if f == g and (p < 0 or p != q) and bits(x, y) <= 4:
                want.link(x, y)
    names = {x for _, _, x in rows}
    assert len({own.find(x) for x in names}) == len({want.find(x) for x in names})


def edited(r: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def brute_similar(texts: list[str], least: float = 0.8) -> list[int]:
    """The least position that each text is connected to by pairs of similar 5-word shingle sets."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else {()})
    roots = simhash.Roots()
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                roots.link(max(roots.find(a), roots.find(b)), min(roots.find(a), roots.find(b)))
    return [roots.find(k) for k in range(len(texts))]


@pytest.mark.parametrize("members", [2048, 5])
def test_near_copies_are_verified(spark, monkeypatch, members):
    """Against brute force: groups around a text, chains of copies, shuffled texts of the same words, empty and short ones."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "MEMBERS", members)  # 5: groups are split, and pairs of parts meet
    r = random.Random(3)
    texts: list = []
    for k in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(150)]
        texts += [" ".join(words), " ".join(words).upper(), *[edited(r, words, r.choice((1, 2, 3, 9))) for _ in range(r.randint(0, 9))]]
        texts.append(" ".join(r.sample(words, len(words))))
    texts += ["", None, " \n", "one two", "One two", "one two three", texts[0], texts[3]]
    want = brute_similar(texts)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x")], "doc_id bigint, text string, digest string")
    found = simhash.deduplicated(docs.repartition(4))
    assert found.columns == docs.columns
    assert sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in found.collect()) == [-1, *sorted(set(want))]
    assert found.where(F.col("digest") != "x").count() == 0


def test_rows_of_one_id_and_different_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(reversed(words))), (2, " ".join(reversed(words)) + " end"), (3, " ".join(words) + " end")]
    found = simhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(rows[:2])


def test_hubs_are_joined_apart(spark, monkeypatch):
    """A star of many edges, with its hub split off and not."""
    from pyspark.sql import functions as F

    edges = [(5, 10 + k) for k in range(3000)] + [(10 + k, 9000 + k) for k in range(0, 3000, 7)] + [(1, 2), (2, 3)]
    for hub in (1000, 100_000):
        monkeypatch.setattr(simhash, "HUB", hub)
        found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
        got = {r["root"]: r["n"] for r in found.groupBy("root").agg(F.count_distinct("node").alias("n")).collect()}
        assert got == {5: len({x for e in edges[:-2] for x in e}), 1: 3}
