from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import decontam


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[!-/:-@\[-`{-~ \t-\r]+", lower) if w]


def brute(docs: list[tuple], items: list[tuple]) -> dict:
    """(doc, item) -> best similarity over all windows, 0.8 or more."""
    out = {}
    for i, item in items:
        w = words(item)
        if not w:
            continue
        n = min(5, len(w))
        cut = lambda x: [tuple(x[k : k + n]) for k in range(len(x) - n + 1)]
        want = cut(w)
        for d, text in docs:
            have = cut(words(text))
            if not set(have) & set(want):
                continue
            best = 0.0
            for k in range(max(1, len(have) - len(want) + 1)):
                a, b = Counter(have[k : k + len(want)]), Counter(want)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + len(want) - both))
            if best >= 0.8:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def planted(seed: int) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re")) for _ in range(r.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(r.randint(12, 60)))) for k in range(12)] + [(50, "short item"), (51, None), (52, "...")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(r.randint(0, 200))]
        if k % 2:
            w = items[k % 12][1].split()
            if k % 3 == 0:  # one word changed
                w[r.randrange(len(w))] = "other"
            if k % 5 == 0:
                w = [x.upper() + r.choice(",.!") for x in w]
            at = r.randint(0, len(body))
            body[at:at] = w
        docs.append((k, " ".join(body)))
    docs += [(100, "Short, ITEM!"), (101, None), (102, " ".join(items[3][1].split()[:-2])), (103, items[4][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    docs, items = planted(seed)
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    want = brute(docs, items)
    assert set(got) == set(want) and len(found) == len(got)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = planted(4)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontam.leaks(d, b).collect()))
    clean = sorted(r["doc_id"] for r in decontam.decontaminated(d, b).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, decontam.leaks(d, b).collect())) == whole
    assert sorted(r["doc_id"] for r in decontam.decontaminated(d, b).collect()) == clean == sorted({k for k, _ in docs} - {r[0] for r in whole})


def test_lookup_misses_nothing_within_the_radius():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 1000, 30)) for _ in range(40)]
    index = decontam.Index(list(enumerate(texts)))
    (size,) = index.classes
    near = size.prints.copy()
    for k in range(len(near)):
        for b in r.choice(64, k % (decontam.RADIUS + 1), replace=False):
            near[k] ^= np.uint64(1 << int(b))
    window, item = size.lookup(near)
    want = {(a, b) for a in range(len(near)) for b in range(len(near)) if int(near[a] ^ size.prints[b]).bit_count() <= decontam.RADIUS}
    assert set(zip(window.tolist(), item.tolist())) == want


def test_memory_of_a_long_text():
    """An item at both ends of a text of some MB: what is held besides the words stays small."""
    import tracemalloc

    item = " ".join(f"w{k}" for k in range(40))
    index = decontam.Index([(7, item)])
    r = np.random.default_rng(2)
    text = item + " " + " ".join(map(str, r.integers(0, 99999, 700_000))) + " " + item
    raw = np.frombuffer(text.encode(), np.uint8)
    tracemalloc.start()
    found = list(index.search(raw, np.array([0, len(raw)]), decontam.WordHasher(decontam.FOLD)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 0, 0, 1.0)] and peak < 25 * len(raw)


def test_size_of_a_block():
    """What is sent of a block of items follows its text by a bound, and so does what making it takes."""
    import pickle
    import tracemalloc

    r = np.random.default_rng(7)
    vocabulary = ["".join(r.choice(["an", "er", "th", "on", "re", "in"], 3)) + str(k) for k in range(5000)]
    items = [(k, " ".join(vocabulary[x] for x in r.integers(0, 5000, int(r.integers(20, 50))))) for k in range(6000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = decontam.Index(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(index)) < 5 * size and peak < 16 * size


def test_blocks_are_released_one_after_another(spark, monkeypatch):
    docs, items = planted(5)
    live, most = set(), []
    real = type(spark.sparkContext).broadcast

    def watched(self, value):
        sent = real(self, value)
        if isinstance(value, decontam.Index):
            live.add(id(sent))
            most.append(len(live))
            destroy = sent.destroy
            sent.destroy = lambda: (live.discard(id(sent)), destroy())
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    decontam.leaks(d, b).collect()
    decontam.decontaminated(d, b).collect()
    assert len(most) > 4 and max(most) == 1


def test_tables_without_rows(spark):
    docs, items = planted(6)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.leaks(d.limit(0), b).count() == 0 == decontam.leaks(d, b.limit(0)).count()
    assert decontam.decontaminated(d, b.limit(0)).count() == d.count()
