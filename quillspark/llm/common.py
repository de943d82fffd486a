"""What several of the operators share: shared storage, tables, words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import new_path, shared_dir, written

__all__ = ["BLANK", "FOLD", "WORD", "WordHasher", "batch_of", "batches", "few", "head_from", "joined_by", "lean", "mixed", "n_words", "new_path", "parts", "pieces", "shared_dir", "size_class", "slices", "table", "texts", "written"]

#: A word is a run of anything but these characters (space, tab to carriage return).
#: ``bytes.split()`` splits at exactly this set, which the Python paths rely on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows out of tuples, for the end of a ``mapInArrow`` function."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def lean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches one after another; memory that Arrow holds of earlier ones goes back to the system."""
    for frame in frames:
        pa.default_memory_pool().release_unused()
        yield frame


def slices(frame: pa.RecordBatch, column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch, some MB of one of its string columns at a time; at least a row."""
    a, upto = 0, np.cumsum(pc.fill_null(pc.binary_length(frame.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while a < frame.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, side="right")))
        yield frame.slice(a, b - a)
        a = b


def few(rows: DataFrame, tag: str, most: int = 10_000) -> DataFrame:
    """``rows``, written to the shared folder, and marked for broadcasting only if they are counted to be ``most`` or fewer."""
    rows = written(rows, tag)
    return F.broadcast(rows) if rows.count() <= most else rows


def joined_by(big: DataFrame, small: DataFrame, key: str, total: int, least: int = 1000) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, and in ``n`` the number of the key's rows in ``big``.

    Keys with more than a ten-thousandth of ``big``'s ``total`` rows, of which there can't be more than ten thousand, are
    broadcast, so none of them meets in one task; the others are shuffled. A key of ``least`` rows or fewer is never in
    the way.
    """
    limit = max(total // 10_000, least)
    if total <= limit:
        return big.join(small, key)
    hot = small.where(F.col("n") > limit)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col("n") <= limit), key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def head_from(sizes: DataFrame, most: int) -> int:
    """From (n), the least ``size_class`` such that ``most`` rows at most are of it or a higher one: what is common, whole classes of it."""
    room, least = most, 1 << 20
    # a class is a quarter of a power of two, so there are some 250
    for r in sorted(sizes.groupBy(size_class(F.col("n")).alias("k")).count().collect(), key=lambda r: -r["k"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["k"]
    return least


def size_class(n: F.Column) -> F.Column:
    return F.floor(4 * F.log2(n)).cast("int")


def n_words(text: F.Column) -> F.Column:
    """Number of words of a text column; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHasher:
    """Cuts texts into words and hashes them, all by numpy.

    ``fold`` is a table of 256 bytes that each byte goes through first (lower case, marks to blanks). A word's hash is
    a sum of random 64-bit values, one for each byte at each place, mixed. Sums can be taken up where they were left,
    so texts of any length are hashed ``WINDOW`` bytes at a time; what is held of all of it are a few bytes a byte.
    Equal hashes almost surely mean equal words; whoever needs certainty compares the bytes.
    """

    WINDOW = 1 << 18
    _VALUES = np.random.default_rng(11).integers(0, 1 << 64, 64 * 256, np.uint64)

    def __init__(self, fold: np.ndarray | None = None):
        self.fold = fold

    def __call__(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that lie in ``data`` from edge to edge: each word's begin, end and hash, and the edges counted in words."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
        if self.fold is not None:
            data = self.fold[data]
        black = ~BLANK[data]
        begin, end = np.ones(len(data), bool), np.ones(len(data), bool)
        begin[1:] = ~black[:-1]
        begin[edges[:-1][edges[:-1] < len(data)]] = True
        end[:-1] = begin[1:] | ~black[1:]
        begins, ends = np.flatnonzero(begin & black), np.flatnonzero(end & black) + 1
        del begin, end
        hashes = (ends - begins).astype(np.uint64)
        for a in range(0, len(data), self.WINDOW):
            b = a + self.WINDOW
            i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(begins, b, side="left"))
            n = np.minimum(ends[i:j], b) - np.maximum(begins[i:j], a)
            at = np.flatnonzero(black[a:b])  # the bytes of these words, one after another
            place = at + a - np.repeat(begins[i:j], n)
            value = self._VALUES[((place & 63) << 8) | data[a:b][at]]
            far = np.flatnonzero(place >= 64)
            if len(far):
                value[far] = mixed(value[far] + (place[far] >> 6).astype(np.uint64))
            sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
            upto = np.cumsum(n)
            hashes[i:j] += sums[upto] - sums[upto - n]
        return begins, ends, mixed(hashes), np.searchsorted(begins, edges)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit integers, each to another, all bits of it changed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes between words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case for A to Z, and a blank for every ASCII mark.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
FOLD[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins in them. Null: no bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), edges


def pieces(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of a string column, some MB of whole texts at a time: first row, row after, bytes, edges. Null: no bytes."""
    data, edges = _buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + size, side="right")) - 1)
        yield a, b, data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        a = b


def parts(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``pieces``, but a text of more than ``size`` bytes comes in several, cut behind blanks: then its row comes again."""
    for a, b, data, edges in pieces(column, size):
        at = 0
        while len(data) - at > size:
            step = size
            while step < len(data) - at and not BLANK[data[at + step - 1]]:
                back = np.flatnonzero(BLANK[data[at + step - size : at + step]])
                step = step - size + int(back[-1]) + 1 if len(back) else step + size
            if step >= len(data) - at:
                break
            yield a, b, data[at : at + step], np.array([0, step])
            at += step
        yield a, b, data[at:], edges - at if at == 0 else np.array([0, len(data) - at])
