"""Operator 10, benchmark decontamination: SimHash of item-sized windows.

Words are runs of anything but blanks and ASCII marks, in lower case; shingles are five words (all words of a
shorter item). For each benchmark item, windows of as many shingles as the item has slide over every document. A
window's SimHash is looked up in a multi-index over the items of its size: the 64 bits are cut into ``BLOCKS`` blocks,
each of which lists the items by their values, and the lists of all values within ``RADIUS // BLOCKS`` bits of a
window's own are taken, so no fingerprint within ``RADIUS`` bits can be missed. What it finds within the radius is verified by the exact
similarity of the two weighted shingle sets: the sum of the smaller over the sum of the larger occurrence counts, 0.8
or more. Words and shingles are compared by 64-bit hashes.

Only windows that hold a shingle of some item of their size are fingerprinted, as any other has the similarity 0. So
the work is one hash a word, and a few windows around what is shared. Bits of a window come from running sums, over
``SPAN`` shingles and an item's length at a time, wherever in a text they are: what is held of a very long text are
some ten bytes for each of its bytes.

The benchmark is a stated query set. It is read in blocks of about ``BLOCK_BYTES`` of text, whose number follows its
measured size. Each is made into flat arrays, some four bytes for each of its own, and broadcast; the documents pass by
it, what they hold of it is written to the shared folder, and the block is released before the next is made, so driver
and workers hold one. One block alone is passed by as the result is read. Documents aren't shuffled; of several blocks
only the keys of the documents that hold an item are kept, and taken out at the end.

An empty benchmark takes nothing out and an empty table gives no rows. Null and empty texts and items match nothing. Items that tie in a document each give their row. A document shorter than an item is one window. Of several windows of a
pair the most similar one counts, then the first. Repeated rows each give their pairs. Clashing extra columns of the
documents are not read by ``leaks`` and are kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import FOLD, WordHasher, few, lean, pieces, table, written

SHINGLE_WORDS = 5
RADIUS = 17
BLOCKS = 6
SPAN = 4096
SIMILAR = 0.8
BLOCK_BYTES = 16 << 20

#: Odd factors of a shingle's words.
_FACTORS = (np.random.default_rng(3).integers(0, 1 << 63, SHINGLE_WORDS, np.uint64) << np.uint64(1)) | np.uint64(1)

PAIRS = "doc_id bigint, item_id bigint, start_word bigint, distance int, similarity double"
PAIRS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, given the words' hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : k + len(h)] * _FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def prints(votes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of windows of ``n`` shingles, given how many of them set each bit (a row for each window)."""
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view(np.uint64).ravel()


def running(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the 64 bits, with a row of zeros first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
#: For each block what makes a value into all those within the block's share of the radius.
_FLIPS = [np.array([sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), n)]) for width in np.diff(_EDGES).tolist()]


def block_values(found: np.ndarray) -> list[np.ndarray]:
    """The value of each block of fingerprints."""
    return [((found >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(_EDGES, _EDGES[1:])]


@dataclass
class SizeClass:
    """Items of the same shingle length ``n`` and the same number of shingles ``m``."""

    n: int
    m: int
    items: np.ndarray  # places in the benchmark
    prints: np.ndarray
    edges: np.ndarray  # of each item in the next two
    distinct: np.ndarray  # shingles, in order
    often: np.ndarray  # how often the item has them
    postings: list[tuple[np.ndarray, np.ndarray]]  # for each block: values in order, and their items

    @classmethod
    def of(cls, n: int, m: int, items: list[int], hashes: list[np.ndarray]) -> SizeClass:
        fp = np.array([prints(running(h)[-1:], m)[0] for h in hashes], np.uint64)
        counts = [np.unique(h, return_counts=True) for h in hashes]
        listed = [(values[order].astype(np.uint16), order.astype(np.int32)) for values in block_values(fp) for order in [np.argsort(values, kind="stable")]]
        edges = np.cumsum([0, *(len(d) for d, _ in counts)])
        return cls(n, m, np.array(items, np.int32), fp, edges, np.concatenate([d for d, _ in counts]), np.concatenate([k for _, k in counts]).astype(np.int32), listed)

    def lookup(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all items within the radius of the windows' fingerprints."""
        pairs = []
        for (known, items), values, flips in zip(self.postings, block_values(found), _FLIPS):
            near = (values[:, None] ^ flips[None, :]).astype(np.uint16).ravel()
            low = np.searchsorted(known, near, "left")
            n = np.searchsorted(known, near, "right") - low
            at = np.flatnonzero(n)
            low, n = low[at], n[at]
            w = np.repeat(at // len(flips), n)
            pairs.append(w * len(self.items) + items[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(w))])
        w, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        close = np.bitwise_count(found[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str]]):
        hasher = WordHasher(FOLD)
        self.ids = [i for i, _ in items]
        groups: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            words = hasher(raw, np.array([0, len(raw)]))[2]
            if len(words):
                n = min(SHINGLE_WORDS, len(words))
                h = shingles(words, n)
                places, hashes = groups.setdefault((n, len(h)), ([], []))
                places.append(k)
                hashes.append(h)
        self.classes = [SizeClass.of(n, m, *groups.pop((n, m))) for n, m in sorted(groups)]
        self.anchors = {}  # by shingle length: a coarse table of bits, sorted shingles, and their classes
        for n in {c.n for c in self.classes}:
            own = [(k, np.unique(c.distinct)) for k, c in enumerate(self.classes) if c.n == n]
            h, of = np.concatenate([d for _, d in own]), np.repeat(np.array([k for k, _ in own], np.int32), [len(d) for _, d in own])
            order = np.argsort(h, kind="stable")
            coarse = np.zeros(1 << 20, bool)
            coarse[h >> np.uint64(44)] = True
            self.anchors[n] = coarse, h[order], of[order]

    def search(self, data: np.ndarray, edges: np.ndarray, hasher: WordHasher) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, place of the item, first word, distance, similarity) of texts that lie in ``data`` from edge to edge."""
        _, _, words, cut = hasher(data, edges)
        for n, (coarse, known, of) in self.anchors.items():
            h = shingles(words, n)
            at = np.flatnonzero(coarse[h >> np.uint64(44)])
            low, high = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            text = np.searchsorted(cut, at, side="right") - 1
            inside = at + n <= cut[text + 1]
            at, text, low, high = at[inside], text[inside], low[inside], high[inside]
            each = np.repeat(np.arange(len(at)), high - low)
            kind = of[np.repeat(low, high - low) + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
            order = np.lexsort((at[each], kind, text[each]))
            each, kind = each[order], kind[order]
            turn = np.flatnonzero(np.r_[True, (text[each][1:] != text[each][:-1]) | (kind[1:] != kind[:-1])]) if len(each) else []
            for a, b in zip(turn, [*turn[1:], len(each)]):
                t = int(text[each[a]])
                yield from self._windows(t, self.classes[kind[a]], h, at[each[a:b]], int(cut[t]), int(cut[t + 1]) - n + 1)

    def _windows(self, text: int, c: SizeClass, h: np.ndarray, anchors: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int, int, float]]:
        """The matches of one text, whose shingles are ``h[first:last]``, with items of one size."""
        m = min(c.m, last - first)
        lo, hi = np.maximum(first, anchors - m + 1), np.minimum(anchors, last - m)
        new = np.maximum(lo, np.r_[first, np.maximum.accumulate(hi)[:-1] + 1])  # where ranges overlap, each start once
        n = np.maximum(0, hi - new + 1)
        starts = np.repeat(new - (np.cumsum(n) - n), n) + np.arange(n.sum())
        best: dict[int, tuple[float, int, int]] = {}
        k = 0
        while k < len(starts):
            s = starts[k : k + int(np.searchsorted(starts[k:], starts[k] + SPAN))]
            k += len(s)
            base, span = int(s[0]), h[s[0] : s[-1] + m]
            sums = running(span)
            found = prints(sums[s - base + m] - sums[s - base], m)
            w, i = c.lookup(found)
            for item in np.unique(i).tolist():
                a, b = c.edges[item], c.edges[item + 1]
                distinct, often = c.distinct[a:b], c.often[a:b]
                place = np.minimum(np.searchsorted(distinct, span), len(distinct) - 1)
                place[distinct[place] != span] = len(distinct)
                for j in w[i == item].tolist():
                    held = np.bincount(place[s[j] - base : s[j] - base + m], minlength=len(distinct) + 1)[:-1]
                    both = int(np.minimum(held, often).sum())
                    now = both / (m + c.m - both), -int(s[j])
                    if now[0] >= SIMILAR and (item not in best or now > best[item][:2]):
                        best[item] = *now, int(np.bitwise_count(found[j] ^ c.prints[item]))
        for item, (similar, start, distance) in best.items():
            yield text, int(c.items[item]), -start - first, distance, similar


def parts_of(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark (item_id, text) in blocks of about ``BLOCK_BYTES`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def index_of(part: DataFrame) -> Index:
    return Index(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0], x[1])))


def passed(docs: DataFrame, benchmark: DataFrame, by: Callable[[Broadcast], Callable], schema: T.StructType | str) -> DataFrame:
    """The rows that ``by`` makes of all documents and each block, of which one is held at a time."""
    context, parts = docs.sparkSession.sparkContext, parts_of(benchmark)
    if len(parts) == 1:
        return docs.mapInArrow(by(context.broadcast(index_of(parts[0]))), schema)
    out = docs.sparkSession.createDataFrame([], schema)
    for part in parts:
        sent = context.broadcast(index_of(part))
        out = out.union(written(docs.mapInArrow(by(sent), schema), "benchmark-block"))
        sent.destroy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, start_word, distance, similarity."""

    def by(sent: Broadcast) -> Callable:
        def pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hasher = sent.value, WordHasher(FOLD)
            for frame in lean(frames):
                ids = frame.column("doc_id").cast(pa.int64()).to_pylist()
                rows = [(ids[a + t], index.ids[i], start, distance, similar) for a, _, data, edges in pieces(frame.column("text")) for t, i, start, distance, similar in index.search(data, edges, hasher)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PAIRS_ARROW)], schema=PAIRS_ARROW)

        return pairs

    return passed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, by, PAIRS)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item.

    With several blocks these are known by a hash of their text and its length, and joined out; copies go together.
    """

    def holding(index: Index, hasher: WordHasher, frame: pa.RecordBatch) -> np.ndarray:
        held = np.zeros(frame.num_rows, bool)
        for a, _, data, edges in pieces(frame.column("text")):
            for t, *_ in index.search(data, edges, hasher):
                held[a + t] = True
        return held

    def by(sent: Broadcast, clean: bool) -> Callable:
        def chosen(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher(FOLD)
            for frame in lean(frames):
                held = holding(sent.value, hasher, frame)
                yield frame.filter(pa.array(held != clean))

        return chosen

    n = len(parts_of(benchmark))
    if n <= 1:
        return passed(docs, benchmark, lambda sent: by(sent, True), docs.schema) if n else docs
    key = [F.xxhash64("text").alias("_key"), F.octet_length("text").alias("_bytes")]
    texts_ = docs.select("text", *key)
    found = passed(texts_, benchmark, lambda sent: by(sent, False), texts_.schema)
    keys = few(found.select(F.col("_key").alias("_k"), F.col("_bytes").alias("_b")).distinct(), "benchmark-holders")
    return docs.join(keys, (F.xxhash64(docs.text) == keys._k) & (F.octet_length(docs.text) == keys._b), "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "distance", F.round("similarity", 9).alias("similarity"))
