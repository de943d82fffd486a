"""Operator 9, quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < 2: toxic, poor, good. One weight vector over hashed words, shared by all grades, and
ordered thresholds give P(grade > k) = sigmoid(weights . x - threshold_k), hence the expected grade and the tail
probability P(grade = 2), by which documents are selected.

A text's features are its distinct words (runs of letters or digits in lower case, each hashed to ``2 ** BITS``
slots), its words that carry other marks, and how few of its words are distinct; x has these at fixed scale, so one
strong word counts in a long text as in a short one.

Fitting reads a bounded sample of the labelled documents, ``max_labelled`` of the least seeded hash, and runs on the
driver over sparse numpy rows. If these have more than ``max_slots`` entries together, the slots that tell least of the
grade are left out until the others fit: every labelled document stays, however long it is. Scoring covers every
document in one pass; the weights are ``4 << BITS`` bytes.

Null and empty texts have no features but the constant one. A very long text counts by its distinct words, which are
held while it is read. Extra columns stay as they are, but ``score`` replaces those named expected_grade and tail, and
the labels' other columns are not read. Labels of unknown documents or without any rating are passed over; several labels of one document count as the lowest grade. With fewer than two grades in the sample every document is kept
(tail 1, expected grade 2). A tail of exactly the threshold is kept. Repeated rows keep one row each, and count once in
the fit. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import lean, table, texts, written

BITS = 18
GRADES = 3
#: Slots after the hashed words: ten for the share of marked words, ten for that of repeated ones, three for length.
SHAPES = 23
MAX_LABELLED = 12_000
#: Entries (a slot of a document) that are fitted on: the bound of what the driver holds.
MAX_SLOTS = 8_000_000

_MARKED = re.compile(rb"[\x21-\x2b\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]{2,}|[$%#*&|<>]")
_STRIP = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def features(text: str, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """Slots that the text has, each once. ``seen`` remembers words' slots."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.array([(1 << BITS) + SHAPES - 1], np.int64)
    distinct = set(words)
    slots = set()
    mask = (1 << BITS) - 1
    if seen is None:
        seen = {}
    if len(seen) > 100_000:
        seen.clear()
    for w in distinct:
        k = seen.get(w)
        if k is None:
            core = w.strip(_STRIP)
            k = seen[w] = zlib.crc32(core) & mask if core else -1
        slots.add(k)
    slots.discard(-1)
    share = min(9, 10 * len(_MARKED.findall(b" ".join(words))) // len(words))
    again = min(9, 10 * (len(words) - len(distinct)) // len(words))
    slots.add((1 << BITS) + share)
    slots.add((1 << BITS) + 10 + again)
    slots.add((1 << BITS) + 20 + (0 if len(words) < 50 else 1))
    return np.fromiter(slots, np.int64, len(slots))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; none: nothing was learned

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(slots: np.ndarray, lens: np.ndarray, grades: np.ndarray, steps: int = 200, rate: float = 0.1, sparse: float = 3e-4, least_rows: int = 4) -> Model:
    """Fit rows of ``lens`` slots each, which lie one after another in ``slots``.

    Maximum likelihood by Adam on all rows at once; rare grades weigh more, by the square root of their rarity.

    An absolute-value penalty on words (``sparse``) and a least number of rows of a slot (``least_rows``) leave weights only to
    what many documents of a grade share; else the many rare words of a long text would outvote the few that tell.
    """
    present = np.unique(grades)
    size = (1 << BITS) + SHAPES
    if len(present) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(0))
    at = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    common = np.bincount(slots, minlength=size) >= least_rows
    keep = common[slots]
    slots, at = slots[keep], at[keep]
    used = np.flatnonzero(common)
    column = (np.cumsum(common, dtype=np.int32) - 1)[slots]
    del keep, slots
    w = np.zeros(len(used))
    cut = np.array([-1.0, np.log(2.0)])  # first threshold, logarithm of the gap to the next
    balance = np.sqrt(len(grades) / (len(present) * np.bincount(grades, minlength=GRADES)[grades]))
    penalty = np.where(used < 1 << BITS, sparse, 0.0)
    above = grades[:, None] > np.arange(GRADES - 1)[None, :]
    m, v = [np.zeros_like(w), np.zeros_like(cut)], [np.zeros_like(w), np.zeros_like(cut)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        score = np.bincount(at, weights=w[column], minlength=len(lens))
        theta = np.array([cut[0], cut[0] + np.exp(cut[1])])
        tail = sig(score[:, None] - theta[None, :])
        p = np.where(grades == 0, 1 - tail[:, 0], np.where(grades == 1, tail[:, 0] - tail[:, 1], tail[:, 1]))
        slope = tail * (1 - tail)  # of each tail by the score
        d0 = np.where(grades == 0, -slope[:, 0], np.where(grades == 1, slope[:, 0], 0.0))
        d1 = np.where(grades == 1, -slope[:, 1], np.where(grades == 2, slope[:, 1], 0.0))
        scale = -balance / np.maximum(p, 1e-9) / len(lens)
        by_score, by_theta = scale * (d0 + d1), np.array([-(scale * d0).sum(), -(scale * d1).sum()])
        gradients = [np.bincount(column, weights=by_score[at], minlength=len(used)), np.array([by_theta.sum(), by_theta[1] * np.exp(cut[1])])]
        for k, (x, g) in enumerate(zip((w, cut), gradients)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            pace = rate / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-4)
            x -= pace * (m[k] / (1 - 0.9**step))
            if k == 0:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - pace * penalty, 0)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, np.array([cut[0], cut[0] + np.exp(cut[1])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic 0, poor 1, good 2; the lowest of several."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_slots: int = MAX_SLOTS, seed: int = 5) -> Model:
    """Fit on the ``max_labelled`` labelled documents of the least seeded hash, by their ``max_slots`` most telling entries."""

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in lean(frames):
            slots = [features(t) for t in texts(frame)]
            yield pa.RecordBatch.from_arrays([frame.column("h"), frame.column("doc_id"), frame.column("grade").cast(pa.int32()), pa.array(map(len, slots), pa.int64()), pa.array(slots, pa.list_(pa.int32()))], names=["h", "doc_id", "grade", "n", "slots"])

    chosen = graded(labels).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(max_labelled)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows
    # of several texts of one doc_id the first by code point counts
    once = known.groupBy("h", "doc_id", "grade").agg(F.min("text").alias("text"))
    rows = written(once.mapInArrow(found, "h bigint, doc_id bigint, grade int, n bigint, slots array<int>"), "labelled")
    if (rows.agg(F.sum("n")).first()[0] or 0) > max_slots:
        rows = narrowed(rows, max_slots)
    taken = rows.orderBy("h", "doc_id").select("grade", "slots").toArrow()
    slots = taken.column("slots").combine_chunks()
    return fit(slots.flatten().to_numpy(), np.diff(slots.offsets.to_numpy()), taken.column("grade").to_numpy())


def narrowed(rows: DataFrame, max_slots: int, least_rows: int = 4) -> DataFrame:
    """``rows`` with the slots that tell most of the grade, as many of them as have ``max_slots`` entries in all.

    What a slot tells is the information its presence gives of the grade, for all rows. Ties go to the lower slot.
    """
    counts = rows.select("grade", F.explode("slots").alias("slot")).groupBy("slot").agg(*[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)]).toArrow()  # a row a slot
    of = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    total = np.array([of.get(g, 0) for g in range(GRADES)], float)
    slot, n = counts.column("slot").to_numpy(), np.stack([counts.column(f"n{g}").to_numpy() for g in range(GRADES)], axis=1).astype(float)
    every = total.sum()

    def bits(k: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows times the information between having the slot (k of each grade, of size in all) and the grade."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nansum(np.where(k > 0, k * np.log(k * every / (size[:, None] * total[None, :])), 0.0), axis=1)

    size = n.sum(axis=1)
    told = np.where(size >= least_rows, bits(n, size) + bits(total[None, :] - n, every - size), -1.0)
    order = np.lexsort((slot, -told))
    order = order[told[order] >= 0]
    chosen = order[np.cumsum(size[order]) <= max_slots]
    keep = np.zeros((1 << BITS) + SHAPES, bool)
    keep[slot[chosen]] = True
    sent = rows.sparkSession.sparkContext.broadcast(keep)

    def kept(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in lean(frames):
            slots = [x[sent.value[x]] for x in (np.array(s, np.int64) for s in frame.column("slots").to_pylist())]
            yield frame.set_column(frame.schema.get_field_index("slots"), "slots", pa.array(slots, pa.list_(pa.int32())))

    return rows.mapInArrow(kept, rows.schema)


def judged(column: pa.Array, model: Model, seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grades and tail probabilities of a column of texts."""
    raw = np.array([model.weights[features(t or "", seen)].sum(dtype=np.float64) for k in range(0, len(column), 256) for t in column.slice(k, 256).to_pylist()])
    if not len(model.thresholds):
        return np.full(len(raw), GRADES - 1.0), np.ones(len(raw))
    tails = model.tails(raw)
    return tails.sum(axis=1), tails[:, -1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with expected_grade and tail = P(good); columns of these names are replaced."""
    docs = docs.drop("expected_grade", "tail")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "expected_grade", "tail"]
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for frame in lean(frames):
            expected, tail = judged(frame.column("text"), sent.value, seen)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=names)

    return docs.mapInArrow(scored, schema)


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least``, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def kept(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for frame in lean(frames):
            yield frame.filter(pa.array(judged(frame.column("text"), sent.value, seen)[1] >= least))

    return docs.mapInArrow(kept, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), (F.col("tail") >= 0.5).alias("kept"))
