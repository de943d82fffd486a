"""Which of many patterns each of many texts contains: Aho-Corasick automata in shards.

Patterns are dealt out by ranges of their order, so a shard is an interval of patterns and has one automaton of bounded
size. A text goes to the shards that can hold a pattern which begins at one of its places: mostly one or two for each
place, as all beginnings of what follows lie close together in the order, and to one shard in all while one holds all
patterns. The texts of a shard are dealt out further, as many to a task as it can hold. So there is a row for each text
and shard, not for each piece of a text, and the work is one pass over the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.shared import written

#: Patterns of a shard, and texts that a task holds beside them.
PATTERNS, TEXTS = 200_000, 500_000

_PAIR = pa.schema([("text", pa.string()), ("pattern", pa.string())])


def shards_of(text: str, lows: list[str]) -> set[int]:
    """Shards of which a pattern may begin at a place in ``text``. ``lows``: the first pattern of each shard, in order."""
    if len(lows) == 1:
        return {0}
    out = set()
    at = lambda piece: max(bisect_right(lows, piece) - 1, 0)

    def between(rest: str, a: int, b: int, first: int, last: int) -> None:
        """Shards of the beginnings of ``rest`` of a to b letters, which lie in order; those of a and b are known."""
        if first == last or b - a < 2:
            return
        k = (a + b) // 2
        middle = at(rest[:k])
        out.add(middle)
        between(rest, a, k, first, middle)
        between(rest, k, b, middle, last)

    for k in range(len(text)):
        rest = text[k:]
        first, last = at(rest[:1]), at(rest)
        out |= {first, last}
        between(rest, 1, len(rest), first, last)
    out.add(at(""))
    return out


def contained(texts: DataFrame, patterns: DataFrame, patterns_a_shard: int = PATTERNS, texts_a_task: int = TEXTS) -> DataFrame:
    """(text, pattern) for every pattern that a text contains, each pair once.

    ``texts`` (text) and ``patterns`` (pattern) may have rows again, and null ones, which count for nothing. Letters
    are compared as they are. The empty pattern is in every text.
    """
    spark = texts.sparkSession
    known = written(patterns.select("pattern").where("pattern is not null").distinct(), "patterns")
    n = max(1, -(-known.count() // patterns_a_shard))
    dealt = written(known.repartitionByRange(n, "pattern").withColumn("shard", F.spark_partition_id()), "pattern-shards")
    # a row a shard; Spark's order of texts is that of code points, as Python's
    bounds = sorted((r["low"], r["shard"]) for r in dealt.groupBy("shard").agg(F.min("pattern").alias("low")).collect())
    if not bounds:
        return spark.createDataFrame([], "text string, pattern string")
    lows, shard = [low for low, _ in bounds], [s for _, s in bounds]

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = [(t, shard[k]) for t in frame.column("text").to_pylist() for k in shards_of(t, lows)]
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.string()), pa.array([s for _, s in some], pa.int32())], names=["text", "shard"])

    routed = written(texts.select("text").where("text is not null").distinct().mapInArrow(route, "text string, shard int"), "routed")
    tasks = {r["shard"]: -(-r["count"] // texts_a_task) for r in routed.groupBy("shard").count().collect()}  # a row a shard
    if not tasks:
        return spark.createDataFrame([], "text string, pattern string")
    sizes = F.broadcast(spark.createDataFrame([*tasks.items()], "shard int, tasks int"))
    mine = routed.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("text"), F.col("tasks")).cast("int").alias("part"), "text")
    theirs = dealt.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), "pattern")

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        machine, empty = ahocorasick.Automaton(), False
        for p in right.column("pattern").to_pylist():
            if p:
                machine.add_word(p, p)
            else:
                empty = True
        machine.make_automaton()
        out_text, out_pattern = [], []
        for t in left.column("text").to_pylist():
            held = {p for _, p in machine.iter(t)} if len(machine) else set()
            if empty:
                held.add("")
            out_text += [t] * len(held)
            out_pattern += sorted(held)
        return pa.table([pa.array(out_text, pa.string()), pa.array(out_pattern, pa.string())], schema=_PAIR)

    return mine.groupBy("shard", "part").cogroup(theirs.groupBy("shard", "part")).applyInArrow(found, "text string, pattern string")
