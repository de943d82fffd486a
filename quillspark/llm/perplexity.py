"""Operator 2, quality rules: base rules, and the perplexity of a modified Kneser-Ney model.

The base rules count words, symbols, repeated lines and repeated windows of three words in each whole text.

The model is of n-grams of ``ORDER`` characters of the lower-case text, one model for each value of ``lang`` (null and
empty: one). A character is one of ``SYMBOLS`` symbols: itself below U+0800, so the letters of Latin, Greek, Cyrillic,
Hebrew and Arabic stay apart; those beyond share the other half by a hash; white space, digits and ASCII marks are one
symbol each. Spark counts all n-grams of all texts; continuation counts, counts of counts, the three discounts of each
order and the interpolated probabilities follow by grouping and joins over the distinct n-grams. A probability is kept
as its *cost*, -ln p in whole millionths, so that sums do not depend on their order.

A text is scored by the distinct n-grams of a piece of it. The most common n-grams, ``HEAD`` at most over all
languages, are broadcast as sorted arrays of 64-bit hashes with their costs, searched by bisection. What is not found
there leaves the task as (row, n-gram, times) and meets the rest of the model in a join; the sums are the same
whatever the part that is broadcast. Both models and tails grow with the corpus, and nothing of them with it in memory.

Bands: the log-perplexities, to a ten-thousandth, of the documents that pass the base rules and have ``LEAST``
n-grams or more give each language a median and quartiles; documents further from the median than ``WIDTH`` times the
distance of the quartile on that side are rejected. Only a spread of next to nothing, as many copies of one text make
it, counts as ``SLACK`` in the logarithm.

Null and empty texts have no words, so the base rules reject them; perplexity is null then. Repeated rows count as
often as they occur. Documents of fewer than ``LEAST`` n-grams, and those of languages with fewer than ``LEAST_DOCS``
documents to make a band of, get the base verdict. A document on a band's very edge is kept. Very long texts are
scored ``PIECE`` characters at a time; the base rules hold the words of one text. Extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, few, head_from, lean, mixed, size_class, slices, table, texts, written

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
LEAST, LEAST_DOCS = 200, 20
WIDTH, SLACK = 5.0, 0.03
#: N-grams that are broadcast, 12 bytes each.
HEAD = 1 << 20
#: Characters that are looked at in one go; the arrays for one take some forty bytes.
PIECE = 1 << 19
#: Distinct n-grams that a task sums up before it hands them on.
HELD = 1 << 20
UNIT = 1_000_000
_PAD = " " * (ORDER - 1)
_BLANKS = np.array([0x20, *range(0x09, 0x0E)])


def _ascii() -> np.ndarray:
    fold = np.arange(128, dtype=np.int64)
    fold[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x2E  # marks
    fold[_BLANKS] = 0x20
    fold[0x30:0x3A] = 0x30
    return fold


_ASCII = _ascii()


def symbols(text: str) -> np.ndarray:
    """The symbols of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = points.astype(np.int64)
    plain = points < 128
    out[plain] = _ASCII[points[plain]]
    far = points >= SYMBOLS // 2
    if far.any():
        out[far] = SYMBOLS // 2 + (mixed(points[far].astype(np.uint64)) % np.uint64(SYMBOLS // 2)).astype(np.int64)
    return out


def grams(found: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end in each text of (the ORDER - 1 characters before it, text), and how many each has."""
    sizes = np.fromiter((len(x) for _, x in found), np.int64, len(found))
    wide = symbols("".join(before + x for before, x in found))
    codes = np.zeros(max(0, len(wide) - ORDER + 1), np.int64)
    for k in range(ORDER):
        codes = (codes << BITS) | wide[k : k + len(codes)]
    # n-grams that begin in one text and end in the next are none: each text has as many as characters
    return codes[np.repeat((ORDER - 1) * np.arange(len(sizes)), sizes) + np.arange(sizes.sum())], sizes


def _pieces(frame: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, rows, codes and how many each row has: texts of a language together, a long one in several pieces."""
    names = np.array(frame.column("language").to_pylist(), object)
    found = texts(frame)
    for name in sorted(set(names.tolist())):
        rows: list[int] = []
        held: list[tuple[str, str]] = []
        size = 0
        for row in np.flatnonzero(names == name).tolist():
            text = found[row].lower()
            for a in range(0, len(text), PIECE):
                part = text[a : a + PIECE]
                rows.append(row)
                held.append((text[a - ORDER + 1 : a] if a else _PAD, part))
                size += len(part)
                if size >= PIECE:
                    yield name, np.array(rows), *grams(held)
                    rows, held, size = [], [], 0
        if held:
            yield name, np.array(rows), *grams(held)


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    distinct, which = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(language, code, n): how often each n-gram occurs in the texts of ``docs`` (language, text)."""
    schema = pa.schema([("language", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, found in held.items():
                codes, n = summed(*(np.concatenate(x) for x in zip(*found)))
                for k in range(0, len(codes), 1 << 16):
                    c = codes[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(c), pa.array(n[k : k + (1 << 16)])], schema=schema)
            held.clear()

        for frame in lean(frames):
            for some in slices(frame):
                for name, _, codes, _ in _pieces(some):
                    held.setdefault(name, []).append(np.unique(codes, return_counts=True))
            if sum(len(c) for found in held.values() for c, _ in found) > 2 * HELD:
                for name, found in held.items():
                    held[name] = [summed(*(np.concatenate(x) for x in zip(*found)))]
                if sum(len(found[0][0]) for found in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    return docs.select("language", "text").mapInArrow(count, "language string, code bigint, n bigint").groupBy("language", "code").agg(F.sum("n").alias("n"))


def _suffix(level: int) -> F.Column:
    return F.col("code").bitwiseAND(F.lit((1 << (BITS * (level - 1))) - 1))


def levels(counted: DataFrame) -> DataFrame:
    """(language, level, code, n): counts of the highest order, continuation counts of the lower ones, down to one symbol."""
    out = counted.withColumn("level", F.lit(ORDER))
    now = counted
    for level in range(ORDER, 1, -1):
        # how many different symbols the n-gram follows
        now = now.groupBy("language", _suffix(level).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(now.withColumn("level", F.lit(level - 1)))
    return out.select("language", "level", "code", "n")


def discounted(level_counts: DataFrame) -> DataFrame:
    """``levels`` with, for each n-gram, the discounted share of its context and the weight that the context leaves.

    Discounts are those of modified Kneser-Ney for counts of one, two, and three or more, from the counts of counts of
    the language and level; where these are too few, 0.5, 1 and 1.5 stand in.
    """
    some = level_counts.groupBy("language", "level").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    of = [F.when(known, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(float(k) - 0.05))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)]
    rows = level_counts.join(few(some.select("language", "level", *of), "gram-discounts"), ["language", "level"]).withColumn("context", F.shiftright("code", BITS))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # a context is followed by at most SYMBOLS different symbols
    mine = Window.partitionBy("language", "level", "context")
    total = F.sum("n").over(mine)
    return rows.withColumn("share", (F.col("n") - d) / total).withColumn("left", F.sum(d).over(mine) / total).select("language", "level", "code", "n", "share", "left")


def costs(counted: DataFrame) -> DataFrame:
    """(language, code, n, cost) of the n-grams of the highest order: interpolated through all lower ones."""
    rows = written(discounted(written(levels(counted), "gram-levels")), "gram-shares")
    lower = None
    for level in range(1, ORDER + 1):
        here = rows.where(F.col("level") == level).drop("level")
        if lower is None:
            p = F.col("share") + F.col("left") / SYMBOLS
        else:
            # every n-gram's suffix has been counted, and at most SYMBOLS n-grams have one suffix
            here = here.withColumn("_suffix", _suffix(level)).join(lower, ["language", "_suffix"])
            p = F.col("share") + F.col("left") * F.col("_lower")
        here = here.withColumn("p", p)
        lower = here.select("language", F.col("code").alias("_suffix"), F.col("p").alias("_lower"))
    return here.select("language", "code", "n", F.round(-F.log("p") * UNIT).cast("long").alias("cost"))


def train(docs: DataFrame) -> DataFrame:
    """``costs`` of the texts of ``docs`` (language, text), written."""
    return written(costs(written(counts(docs), "gram-counts")), "gram-costs")


class Head:
    """One language's common n-grams: sorted 64-bit hashes and their costs."""

    def __init__(self, codes: np.ndarray, cost: np.ndarray):
        h = hashed(codes)
        order = np.argsort(h)
        self.keys, self.costs = h[order], cost[order].astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Cost of each n-gram, -1 where it is not here."""
        if not len(self.keys):
            return np.full(len(codes), -1)
        h = hashed(codes)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.costs[at], -1).astype(np.int64)


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-gram codes, a different one for each code."""
    return mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def heads(rows: pa.Table) -> dict[str, Head]:
    language = rows.column("language").to_numpy()
    code, cost = (rows.column(k).to_numpy() for k in ("code", "cost"))
    return {name: Head(code[language == name], cost[language == name]) for name in set(language.tolist())}


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif not line.isspace() and line:
            seen.add(line)
    repeated = 0
    if n >= 3:
        names: dict[bytes, int] = {}
        w = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, n)
        size = len(names)
        if size < 1 << 21:
            windows = (w[:-2] * size + w[1:-1]) * size + w[2:]
        else:
            windows = np.unique(np.stack([w[:-2], w[1:-1], w[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return n, len(text) - blanks, symbols, dup, repeated


RULED = "row bigint, doc_id bigint, language string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_grams bigint, cost bigint, tail array<struct<code:bigint,times:bigint>>"
RULED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("language", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())])


def measured(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """The base rules and the log-perplexity of each row of ``docs`` (doc_id, lang, text), by the model of all of them."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("language"), "text")
    model = train(docs)
    common = size_class(F.col("n")) >= head_from(model, head)
    sent = docs.sparkSession.sparkContext.broadcast(heads(model.where(common).select("language", "code", "cost").toArrow()))

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Head(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for frame in (some for frame in lean(frames) for some in slices(frame)):
            n_grams, cost = np.zeros(frame.num_rows, np.int64), np.zeros(frame.num_rows, np.int64)
            open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
            for name, row, codes, n in _pieces(frame):
                distinct, which = np.unique(codes, return_inverse=True)
                each = sent.value.get(name, none).find(distinct)
                of = np.repeat(np.arange(len(row)), n)
                np.add.at(cost, row, np.bincount(of, weights=np.maximum(each, 0)[which], minlength=len(row)).astype(np.int64))
                np.add.at(n_grams, row, n)
                lost = np.flatnonzero(each[which] < 0)
                pairs, times = np.unique(of[lost] * len(distinct) + which[lost], return_counts=True)
                open_.append((row[pairs // max(1, len(distinct))], distinct[pairs % max(1, len(distinct))], times))
            row, code, times = (np.concatenate(x) for x in zip(*open_))
            order = np.argsort(row, kind="stable")
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(frame.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(code[order]), pa.array(times[order])], names=["code", "times"]))
            out = []
            for ids, text in zip(zip(*(frame.column(k).to_pylist() for k in range(3))), texts(frame)):
                r = base_rules(text)
                out.append((*ids, *r, r[0] < 50 or 100 * r[4] > 50 * r[0]))
            base = batch_of(out, RULED_ARROW)
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(n_grams), pa.array(cost), tail], names=[*RULED_ARROW.names, "n_grams", "cost", "tail"])

    found = written(docs.mapInArrow(rows, RULED), "quality")
    rest = found.select("row", "language", F.explode("tail").alias("_")).select("row", "language", "_.code", "_.times")
    more = rest.join(model.where(~common).select("language", "code", "cost"), ["language", "code"]).groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("more"))
    whole = F.col("cost") + F.coalesce("more", F.lit(0))
    return found.drop("tail").join(more, "row", "left").withColumn("log_perplexity", F.when(F.col("n_grams") > 0, whole / (F.col("n_grams") * UNIT))).drop("row", "cost", "more")


def bands(found: DataFrame) -> DataFrame:
    """(language, low, high) from the documents that pass the base rules."""
    fit = found.where(~F.col("base_failed") & (F.col("n_grams") >= LEAST))
    # a ten-thousandth is a step: there are some 100 000 of them at most, whatever the number of documents
    steps = fit.groupBy("language", F.round(F.col("log_perplexity") * 10_000).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("language")
    upto = F.sum("n").over(by.orderBy("step"))
    total = F.sum("n").over(by)
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("step"))) / 10_000
    q = steps.withColumns({"upto": upto, "total": total}).groupBy("language").agg(F.max("total").alias("total"), *[quartile(k).alias(f"q{k}") for k in (1, 2, 3)])
    reach = lambda a, b: F.greatest(WIDTH * (F.col(a) - F.col(b)), F.lit(SLACK))
    return q.where(F.col("total") >= LEAST_DOCS).select("language", (F.col("q2") - reach("q2", "q1")).alias("low"), (F.col("q2") + reach("q3", "q2")).alias("high"))


def rule(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """``measured`` with the language's band (low, high) and kept."""
    found = written(measured(docs, head), "measured")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True)) | (F.col("n_grams") < LEAST)
    return found.join(few(bands(found), "bands"), "language", "left").withColumn("kept", ~F.col("base_failed") & inside)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"), "language")
