from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import perplexity
from quillspark.llm.perplexity import BITS, ORDER, SYMBOLS, WIDTH, base_rules, grams


def brute_rules(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[words[k], words[k + 1], words[k + 2]] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@given(st.text("ab #|\n\t\x0b\x85é ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_rules(text):
    assert base_rules(text) == brute_rules(text)


def brute_symbol(c: str) -> int:
    if c in " \t\n\x0b\x0c\r":
        return 0x20
    if c in "0123456789":
        return 0x30
    if 0x21 <= ord(c) < 0x7F and not c.isalnum():
        return 0x2E
    return ord(c) if ord(c) < SYMBOLS // 2 else int(perplexity.symbols(c)[0])


def brute_grams(text: str) -> list[int]:
    wide = [0x20] * (ORDER - 1) + [brute_symbol(c) for c in text.lower()]
    return [sum(x << (BITS * (ORDER - 1 - j)) for j, x in enumerate(wide[k : k + ORDER])) for k in range(len(wide) - ORDER + 1)]


def brute_costs(texts: list[str]) -> dict[int, float]:
    """Modified Kneser-Ney by dictionaries: -ln p of each n-gram of the highest order."""
    levels: dict = {ORDER: collections.Counter(c for t in texts for c in brute_grams(t))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = collections.Counter(c & ((1 << (BITS * k)) - 1) for c in levels[k + 1])
    of = {k: collections.Counter(v.values()) for k, v in levels.items()}
    after: dict = collections.defaultdict(list)
    for k, v in levels.items():
        for c, n in v.items():
            after[k, c >> BITS].append(n)

    def discount(k: int, n: int) -> float:
        if not all(of[k][j] for j in (1, 2, 3, 4)):
            return 0.5 * min(n, 3)
        y, j = of[k][1] / (of[k][1] + 2 * of[k][2]), min(n, 3)
        return min(max(j - (j + 1) * y * of[k][j + 1] / of[k][j], 0.05), j - 0.05)

    def probability(k: int, code: int) -> float:
        if k == 0:
            return 1 / SYMBOLS
        same = after[k, code >> BITS]
        left = sum(discount(k, n) for n in same) / sum(same)
        return (levels[k][code] - discount(k, levels[k][code])) / sum(same) + left * probability(k - 1, code & ((1 << (BITS * (k - 1))) - 1))

    return {c: -math.log(probability(ORDER, c)) for c in levels[ORDER]}


@given(st.lists(st.text("ab| 1é你Ж\n", max_size=20), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_grams_follow_their_text(found):
    codes, n = grams([(perplexity._PAD, t.lower()) for t in found])
    assert codes.tolist() == [c for t in found for c in brute_grams(t)] and n.tolist() == [len(t) for t in found]


TEXTS = ["abab abac abad cab dab bad cad", "Abba cabba 77!", "Это просто текст, это ещё текст", "这是一个句子。这是另一个", "", "aaa bbb aab | aab"]


@pytest.mark.parametrize("head", [0, 30, 1 << 20])
def test_log_perplexity_by_hand(spark, monkeypatch, head):
    """Kneser-Ney worked out again by dictionaries, whatever part of the model is broadcast and however texts are cut."""
    monkeypatch.setattr(perplexity, "PIECE", 7)
    rows = [(k, t, lang) for k, (t, lang) in enumerate((t, lang) for lang in ("en", "uk", None) for t in TEXTS)] + [(3, TEXTS[0], "xx")]
    found = perplexity.measured(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), head).collect()
    want = brute_costs(TEXTS)
    alone = brute_costs(TEXTS[:1])
    assert len(found) == len(rows)
    for r in found:
        t = TEXTS[r["doc_id"] % len(TEXTS)] if r["language"] != "xx" else TEXTS[0]
        costs = alone if r["language"] == "xx" else want
        codes = brute_grams(t)
        assert r["n_grams"] == len(codes)
        assert r["log_perplexity"] == (pytest.approx(sum(costs[c] for c in codes) / len(codes), abs=2e-6) if codes else None)


def test_costs_are_of_a_distribution(spark, sf):
    """After a context the probabilities of what follows leave only what goes to symbols that never did."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").selectExpr("coalesce(lang, '') as language", "text")
    model = perplexity.train(docs).toPandas()
    sums = np.exp(-model.cost / perplexity.UNIT).groupby([model.language, model.code // SYMBOLS]).sum()
    assert sums.max() <= 1 + 1e-4 and sums.min() > 0


def test_outliers_go_and_clean_texts_stay(spark):
    r = np.random.default_rng(3)
    parts = ["an", "er", "th", "on", "re", "in", "ing", "and"]
    sentence = lambda n: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(n))
    rows = [(k, sentence(150), "en") for k in range(200)]
    noise = "".join(chr(c) for c in r.integers(97, 123, 600))
    rows.append((900, " ".join(noise[k : k + 5] for k in range(0, 600, 5)), "en"))
    kept = {x["doc_id"]: x["kept"] for x in perplexity.rule(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not kept[900] and all(kept[k] for k in range(200))


def test_spread_alone_sets_the_band(spark):
    """A text that is far out for its language goes, though it is near the median in absolute terms."""
    r = np.random.default_rng(6)
    parts = ["an", "er", "th", "on", "re", "in", "ing", "and"]
    sentence = lambda n, end="": " ".join("".join(r.choice(parts, r.integers(1, 4))) + end for _ in range(n))
    rows = [(k, sentence(600), "en") for k in range(150)]
    rows.append((900, sentence(560) + " " + sentence(40, " |"), "en"))
    found = perplexity.rule(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).toPandas().set_index("doc_id")
    clean = found.log_perplexity[:150]
    q = np.quantile(clean, [0.25, 0.5, 0.75])
    assert found.high[0] - q[1] == pytest.approx(max(perplexity.WIDTH * (q[2] - q[1]), perplexity.SLACK), rel=0.1)
    assert 0 < found.log_perplexity[900] - q[1] < 0.15 and not found.kept[900]
    assert found.kept[:150].sum() >= 147


def test_bands_are_of_quartiles(spark):
    r = np.random.default_rng(8)
    values = np.round(r.normal(2, 0.1, 999), 4)
    rows = [(lang, False, 500, float(v)) for lang in ("en", "") for v in values] + [("en", True, 500, 9.0), ("en", False, 100, 9.0)] + [("few", False, 500, 1.0)] * 19 + [("same", False, 500, 1.5)] * 40
    found = {x["language"]: (x["low"], x["high"]) for x in perplexity.bands(spark.createDataFrame(rows, "language string, base_failed boolean, n_grams bigint, log_perplexity double")).collect()}
    q = [sorted(values)[-(-999 * k // 4) - 1] for k in (1, 2, 3)]
    for lang in ("en", ""):
        assert found[lang] == pytest.approx((q[1] - WIDTH * (q[1] - q[0]), q[1] + WIDTH * (q[2] - q[1])))
    assert "few" not in found and found["same"] == pytest.approx((1.5 - perplexity.SLACK, 1.5 + perplexity.SLACK))


def test_base_verdict(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").collect()}
    for r in perplexity.op2(spark, sf).where("doc_id is not null").collect():
        want = brute_rules(docs[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
