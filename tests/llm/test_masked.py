from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import masked
from quillspark.llm.masked import BASE, EDGE, VOCABULARY, Network, windows


def test_distribution_over_the_vocabulary():
    net = Network.new(np.arange(VOCABULARY, dtype=float))
    around = np.array([[3, 7, EDGE, 900]] * VOCABULARY)
    p = np.exp(net.log_probabilities(around, np.arange(VOCABULARY)))
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_gradients_by_differences():
    r = np.random.default_rng(2)
    net = Network.of([x.astype(np.float64) for x in Network.new().arrays()])
    around, token = r.integers(0, VOCABULARY + 1, (20, 4)), np.sort(r.integers(0, VOCABULARY, 20))
    loss = lambda: -net.log_probabilities(around, token).sum()
    (some, whole), full = net.gradients(around, token), []
    for x, (rows, g) in zip((net.embed, *net.gate, *net.bias[1:]), some, strict=True):
        full.append((x, np.zeros_like(x)))
        full[-1][1][rows] = g
    for x, g in [*full, *zip((net.inner, net.inner_bias, *net.outer, net.bias[0]), whole, strict=True)]:
        assert x.shape == g.shape
        k = int(np.argmax(np.abs(g)))
        old, step = x.flat[k], 1e-5
        x.flat[k] = old + step
        up = loss()
        x.flat[k] = old - step
        down = loss()
        x.flat[k] = old
        assert g.flat[k] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_frequencies_to_begin_with():
    """Without training, and with nothing read off the window, tokens have their plain shares."""
    counts = np.random.default_rng(1).integers(0, 50, VOCABULARY).astype(float)
    net = Network.new(counts)
    for x in net.outer:
        x[:] = 0
    p = np.exp(net.log_probabilities(np.full((VOCABULARY, 4), EDGE), np.arange(VOCABULARY)))
    assert np.allclose(p, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def test_windows_stay_in_their_text():
    assert windows(np.array([1, 2, 3, 9], np.int32), np.array([0, 3, 3, 4])).tolist() == [[EDGE, EDGE, 2, 3], [EDGE, 1, 3, EDGE], [1, 2, EDGE, EDGE], [EDGE] * 4]


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 5, 0], [1] * 70, [30, 4, 0, 100, 31, 32, 33]])
def test_runs_hold_every_token_once_in_its_window(sizes):
    cut = np.cumsum([0, *sizes])
    tokens = np.random.default_rng(4).integers(0, VOCABULARY, cut[-1]).astype("<u2")
    runs = masked.runs_of(tokens, cut)
    found = [[run[k + d] for d in masked.SIDES] for run in runs.tolist() for k in range(masked.RUN) if run[k + masked.REACH] != EDGE]
    assert [run[k] for run in runs.tolist() for k in range(masked.REACH, masked.REACH + masked.RUN) if run[k] != EDGE] == tokens.tolist()
    assert found == windows(tokens, cut).tolist()


def test_gradients_of_runs_are_those_of_their_windows():
    """Also where runs end in edges, and where the tokens don't come out even."""
    r = np.random.default_rng(6)
    net = Network.of([x.astype(np.float64) for x in Network.new().arrays()])
    for sizes in ([3, 0, 1, 200], [500, 12]):
        cut = np.cumsum([0, *sizes])
        tokens = r.integers(0, 60, cut[-1]).astype("<u2")
        order = np.argsort(tokens, kind="stable")
        want, whole = net.gradients(windows(tokens, cut)[order], tokens[order].astype(np.int64))
        got, more = net.run_gradients(masked.runs_of(tokens, cut))
        for table, (rows, g), (rows2, g2) in zip((net.embed, *net.gate, *net.bias[1:]), want, got, strict=True):
            full, full2 = np.zeros_like(table), np.zeros_like(table)
            full[rows] = g
            full2[np.minimum(rows2, len(table) - 1)] += g2
            assert np.allclose(full, full2)
        assert all(np.allclose(a, b) for a, b in zip(whole, more, strict=True))


def test_a_step_sums_embeddings_by_place(monkeypatch):
    """Not once for each of a token's windows."""
    seen, by_row = [], masked.by_row
    monkeypatch.setattr(masked, "by_row", lambda rows, values: seen.append(len(rows)) or by_row(rows, values))
    tokens = np.random.default_rng(8).integers(0, VOCABULARY, masked.BATCH).astype("<u2")
    masked.Descent(Network.new(), masked.RATE).step(masked.runs_of(tokens, np.array([0, masked.BATCH])))
    assert seen and max(seen) < 1.2 * masked.BATCH


def test_logits_beyond_what_exp_takes():
    net = Network.new()
    net.bias[0][0, 3] = 200
    p = net.log_probabilities(np.full((2, 4), EDGE), np.array([3 * BASE**2, 5]))
    assert np.isfinite(p).all() and p[0] > p[1]


def test_chunks_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(masked, "CHUNK", 20)
    r = np.random.default_rng(3)
    rows = [(k // 9, r.integers(0, 999, r.integers(0, 12)).astype("<u2").tobytes()) for k in range(50)]

    def found(size: int) -> list:
        frames = (pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[k : k + size]], pa.int64()), pa.array([x[1] for x in rows[k : k + size]], pa.binary())], names=["shard", "ids"]) for k in range(0, len(rows), size))
        return [(s, t.tolist(), c.tolist(), last) for s, t, c, last in masked._chunks(frames)]

    assert found(1) == found(7) == found(50)
    assert b"".join(np.array(t, "<u2").tobytes() for _, t, _, _ in found(7)) == b"".join(x[1] for x in rows)
    assert sum(last for *_, last in found(7)) == 6


def chained(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts in which neighbours settle a word."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        at = int(r.integers(0, 40))
        out.append((k, " ".join(f"w{(at + j) % 40}" for j in range(200))))
    return out


def test_both_sides_help_on_held_out_texts(spark):
    """Texts in which neighbours settle a word score far above what frequencies alone give, scrambled ones below."""
    docs = spark.createDataFrame(chained(400, 5), "doc_id bigint, text string").repartition(4)
    model = masked.train(docs)
    new = masked.score(spark.createDataFrame(chained(30, 6), "doc_id bigint, text string"), model).toPandas()
    assert new.n_tokens.eq(200).all() and (new.pll / 200).mean() > 0.5 * -np.log(40)
    mixed = " ".join(np.random.default_rng(5).permutation(chained(1, 5)[0][1].split()))
    worse = masked.score(spark.createDataFrame([(0, mixed)], "doc_id bigint, text string"), model).first()
    assert worse["pll"] / 200 < (new.pll / 200).mean() - 1


def words_of(text: str | None) -> list[bytes]:
    return masked.FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def hash_of(word: bytes) -> int:
    return int(masked.WordHasher()(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[2][0])


def test_words_are_counted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    got = {r["word"] % (1 << 64): r["n"] for r in masked.word_counts(docs).collect()}
    want = Counter(hash_of(w) for row in docs.collect() for w in words_of(row["text"]))
    assert got == want


@pytest.fixture
def small(monkeypatch):
    """Several rounds of several shards even for a few texts."""
    monkeypatch.setattr(masked, "ROUNDS", 2)
    monkeypatch.setattr(masked, "SHARD", 2000)


def test_scores_by_plain_loops(spark, sf, small):
    """Every word's probability worked out one by one from counts and weights, whatever part of the words is broadcast."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id is null or doc_id <> 8")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter(hash_of(w) for _, t in rows for w in words_of(t))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    classes = VOCABULARY - 30  # few words have tokens of their own, so classes and rare words matter
    named = sorted(counts, key=lambda h: (-counts[h], signed(h)))[:30]
    token = {h: k for k, h in enumerate(named)} | {h: 30 + (h >> 1) % classes for h in counts if h not in named}
    sums = Counter()
    for h, n in counts.items():
        sums[token[h]] += n

    def brute(net: Network, text: str | None) -> float:
        hashes = [hash_of(w) for w in words_of(text)]
        t = [EDGE, EDGE, *(token[h] for h in hashes), EDGE, EDGE]
        out = 0.0
        for k, h in enumerate(hashes):
            x = np.concatenate([net.embed[t[k + j]] for j in (0, 1, 3, 4)]).astype(float)
            hidden = np.tanh(x @ net.inner + net.inner_bias)
            digits, before = (t[k + 2] // BASE**2, t[k + 2] // BASE % BASE, t[k + 2] % BASE), (0, t[k + 2] // BASE**2, t[k + 2] // BASE)
            for j in range(3):
                z = (hidden * net.gate[j - 1][before[j]] if j else hidden) @ net.outer[j] + net.bias[j][before[j]]
                out += z[digits[j]] - math.log(np.exp(z).sum())
            out += 0 if h in named else math.log(counts[h] / sums[token[h]])
        return out

    scores = []
    for head in (0, 40, 1 << 20):
        model = masked.train(docs, head, classes)
        scores.append(sorted(map(tuple, masked.score(docs, model).collect()), key=str))
        assert scores[-1] == scores[0]
    net = Network.unflat(model.flat)
    want = sorted(((i, len(words_of(t)), brute(net, t)) for i, t in rows), key=lambda r: (str(r[0]), r[1]))
    for (i, n, s), (j, m, u) in zip(sorted(scores[0], key=lambda r: (str(r[0]), r[1])), want, strict=True):
        assert (i, n) == (j, m) and s == pytest.approx(u, abs=1e-4 * max(1, n))


def test_partitions_do_not_matter(spark, small):
    docs = spark.createDataFrame(chained(120, 9), "doc_id bigint, text string")
    one, seven = (masked.train(docs.repartition(k)).flat for k in (1, 7))
    assert np.array_equal(one, seven)


def test_unknown_words(spark, small):
    model = masked.train(spark.createDataFrame(chained(20, 1), "doc_id bigint, text string"))
    found = masked.score(spark.createDataFrame([(1, "never seen before"), (2, None)], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert found[0]["n_tokens"] == 3 and math.isfinite(found[0]["pll"]) and tuple(found[1]) == (2, 0, 0.0)


def test_digits():
    assert BASE**3 == VOCABULARY and masked.CLASSES < VOCABULARY <= 1 << 16
