"""Operator 6, mixing sources to target weights: subset-sum budget fitting.

The size of a document is its number of words (null text: none). Each source's target is its weight's share of all
sizes, at most ``max_epochs`` times the source's size; what a full source cannot take is shared anew by weight until
none is above. A source is taken whole as often as its target allows. For the rest of its budget, its documents are
counted by exact size: a proportional share is taken along the sizes, fractions carried from one to the next, and a
bounded-knapsack dynamic programme over the remaining counts fits the last words, an eighth of the budget or
``WINDOW`` and the longest document at most. The plan
is then a number of documents for each source and size, and which ones is settled by a seeded hash.

What meets in one task is a source's table of sizes and counts: k distinct sizes need k * (k + 1) / 2 words, so the
table grows with the square root of the source at most. Documents are never ranked by the group: a hash bucket's
count says how many of it are taken, rows meet that number by a join, and are ranked within their bucket of a size,
so no window holds more. Rows go through that join whole, with their texts where ``docs`` has them.

Null sources are one source, the last. Documents without words take 0 words; they are taken in the proportion of the
others. A very long text counts by its words alone. Repeated rows (same doc_id and text) are interchangeable, and rows
that tie in their hash go by doc_id. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import n_words, table, written

#: Words that the dynamic programme fits at most, apart from the size of one document.
WINDOW = 1 << 15
#: Hash buckets of a source and size.
BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with target: all words dealt by weight, none above ``max_epochs`` times its size.

    The k-th source by code point has the weight ``weights[k % len(weights)]``; null comes last. Dealing the excess
    again and again ends with min(cap, rate * weight), where the sources of the least cap for their weight are full.
    There is one row for each source here.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    dealt = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # from the first source on that the rate doesn't fill, the rate is this source's
        .withColumn("open_rate", F.when(F.col("rate") < F.col("need"), F.col("rate")))
        .withColumn("final_rate", F.first("open_rate", ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return dealt.select("source", "source_size", F.when(F.col("final_rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final_rate") * F.col("weight"))).alias("target"))


def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size, at most its count, add up to the largest sum within ``budget``."""
    items: list[tuple[int, int]] = []
    # what comes first is taken first, so sizes come in no order of theirs
    for k in sorted(range(len(sizes)), key=lambda k: (sizes[k] * 2654435761 % (1 << 32), k)):
        size, count = sizes[k], counts[k]
        count, step = min(count, budget // size if size else 0), 1
        while count > 0:
            n = min(step, count)
            items.append((k, n))
            count, step = count - n, 2 * step
    came = np.full(budget + 1, -1, np.int64)  # the item that first reached a sum
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for j, (k, n) in enumerate(items):
        step = sizes[k] * n
        new = np.flatnonzero(reached[: budget + 1 - step]) + step
        new = new[~reached[new]]
        came[new] = j
        reached[new] = True
        if reached[budget]:
            break
    out = [0] * len(sizes)
    at = int(np.flatnonzero(reached).max())
    while at:
        k, n = items[came[at]]
        out[k] += n
        at -= sizes[k] * n
    return out


def fit(sizes: list[int], counts: list[int], budget: int, total: int) -> list[int]:
    """Documents to take of each size (ascending), so that their words are the most that ``budget`` holds, or nearly so.

    ``total``: words of all of them. A proportional share first, so that every part of the sizes keeps its part in the
    mix, but for some words that the dynamic programme then fits.
    """
    if budget <= 0 or total <= 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    # of each size and all lesser ones together as many as their share says: sizes that occur once have their turn as well
    share = budget - min(WINDOW, budget // 8)
    upto = [0, *accumulate(counts)]
    take = [b * share // total - a * share // total for a, b in pairwise(upto)]
    left = budget - sum(t * s for t, s in zip(take, sizes))
    for k in reversed(range(len(sizes))):  # rounding may have taken more, by one document at most
        if left < 0 and take[k]:
            take[k] -= 1
            left += sizes[k]
    more = knapsack(sizes, [c - t for c, t in zip(counts, take)], left)
    return [t + m for t, m in zip(take, more)]


PLAN = "source string, size bigint, source_size bigint, target double, epochs int, n_more bigint"


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
    total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    whole = int(round(target))
    epochs = whole // total if total else 1
    frame["epochs"] = epochs
    frame["n_more"] = fit(frame["size"].tolist(), frame["n"].tolist(), whole - epochs * total, total)
    return frame[["source", "size", "source_size", "target", "epochs", "n_more"]]


def plan(counted: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """From (source, size, n): how often each source is taken whole, and how many more of each size."""
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes, weights, max_epochs).withColumnRenamed("source", "goal_source")
    return counted.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").groupBy("source").applyInPandas(_plan, PLAN)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 11, size: F.Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies, how often the mix takes the document (0: not).

    ``docs`` needs doc_id, source and text, or a column ``size`` that stands for the text's words; all its columns are
    kept but those that are named as the results, which are replaced.
    """
    named = docs.drop("source_size", "target", "copies")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(BUCKETS)).cast("int")
    # a source's name with a letter before it, so that null has a name too
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = named.withColumn("size", n_words(F.col("text")) if size is None else size.cast("long")).withColumns({"_source": name, "_bucket": bucket})
    thin = written(sized.groupBy("_source", "size", "_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.when(F.col("_source") != "n", F.substr("_source", F.lit(2)))), "mix-counts")
    planned = plan(thin.groupBy("source", "size").agg(F.sum("n").alias("n")), weights, max_epochs)
    planned = planned.withColumn("_source", name).drop("source")
    # how many of each source, size and bucket: whole buckets up to the one on the border; a hot size has BUCKETS rows at most
    upto = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.least("n", F.col("n_more") - F.coalesce(F.sum("n").over(upto), F.lit(0))))
    rooms = written(thin.drop("source").join(planned, ["_source", "size"]).withColumn("_room", room).select("_source", "size", "_bucket", "_room", "epochs", "source_size", "target"), "mix-plan")
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), "doc_id"))
    copies = F.col("epochs") + (rank <= F.col("_room")).cast("int")
    columns = [c for c in named.columns if c != "size"]
    return sized.join(rooms, ["_source", "size", "_bucket"]).withColumn("copies", copies).select(*columns, "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the columns of ``docs``, whatever their names."""
    packed = docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    taken = mix(packed, size=F.col("words"), **options).where(F.col("copies") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = written(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words")), "mix-sizes")
    return mix(slim, size=F.col("words")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
