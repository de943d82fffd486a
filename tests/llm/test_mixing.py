from __future__ import annotations

import random
import re

from quillspark.llm import mixing
from quillspark.llm.mixing import fit, knapsack


def dealt(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    out, left, free = {n: 0.0 for n in names}, float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(w[n] for n in free)
        share, left = {n: left * w[n] / total for n in free}, 0.0
        for n, x in share.items():
            out[n] += x
            if out[n] > cap * sizes[n]:
                left += out[n] - cap * sizes[n]
                out[n] = cap * sizes[n]
                free.discard(n)
    return out


def test_knapsack_by_brute_force():
    r = random.Random(1)
    for _ in range(60):
        sizes, counts, budget = [r.randint(1, 12) for _ in range(4)], [r.randint(0, 3) for _ in range(4)], r.randint(0, 40)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        took = knapsack(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        assert sum(t * s for t, s in zip(took, sizes)) == max(x for x in sums if x <= budget)


def test_fit_reaches_the_budget():
    r = random.Random(2)
    sizes = sorted(r.sample(range(1, 5000), 400))
    counts = [r.randint(1, 50) for _ in sizes]
    total = sum(s * c for s, c in zip(sizes, counts))
    for share in (0.0, 0.1, 0.37, 0.99, 1.0):
        budget = int(total * share)
        took = fit(sizes, counts, budget, total)
        assert all(0 <= t <= c for t, c in zip(took, counts)) and budget - sum(t * s for t, s in zip(took, sizes)) == 0


def test_op6(spark, sf):
    found = mixing.op6(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").toPandas()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    assert sorted(found["size"]) == sorted(size)
    sums: dict = {}
    for s, n in zip(docs.source, size):
        sums[s] = sums.get(s, 0) + n
    want = dealt(sums)
    got = {s: (g.target.iloc[0], g.source_size.iloc[0], g.taken.sum(), g["size"].max()) for s, g in found.assign(source=found.source.fillna("~")).groupby("source")}
    for s in sums:
        target, source_size, taken, longest = got["~" if s is None else s]
        assert source_size == sums[s] and abs(target - want[s]) < 1e-6 and abs(taken - target) <= max(longest, 1)
    assert (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()
    again = mixing.op6(spark, sf).toPandas()
    key = ["doc_id", "size", "taken", "source"]
    assert sorted(map(str, found[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_rare_sizes_keep_their_part():
    """Sizes that occur once: short and long documents are taken alike."""
    sizes = list(range(10, 4010, 4))
    counts = [1] * len(sizes)
    total = sum(sizes)
    budget = total * 2 // 5
    took = fit(sizes, counts, budget, total)
    assert sum(t * s for t, s in zip(took, sizes)) == budget and all(t in (0, 1) for t in took)
    fourths = [sum(took[k : k + 250]) / 250 for k in range(0, 1000, 250)]
    assert max(fourths) - min(fourths) < 0.15
