"""Operator 7, SimHash near-dedup with pivot distance tables.

Fingerprints: the majority of each bit over the XXH64 values (seed 42) of the text's 4-word shingles. Two
fingerprints link when they differ in at most ``radius`` bits, and linked documents form components.

Only distinct fingerprints are compared. They are dealt by *block keys*: the 64 bits are cut into ``blocks`` blocks,
and for every choice of ``blocks - radius`` blocks a fingerprint is filed under these blocks' bits. Two fingerprints
that differ in at most ``radius`` bits differ in at most ``radius`` blocks, so they share a file: no link is lost,
whatever the number of blocks, which is chosen from the number of fingerprints to keep files short.

Inside a file, each fingerprint has its row of the *pivot table*: its Hamming distances to ``PIVOTS`` reference
fingerprints. Distances obey the triangle inequality, so a pair whose rows differ by more than ``radius`` in any
coordinate is no link. Rows are sorted by the first pivot, which leaves a window to look at; the largest coordinate
difference discards most of the rest; survivors are verified by their exact distance. Pairs that are linked already
by way of others are passed over, so a file gives a spanning forest, never all its pairs.

A file of more than ``FILE_ROWS`` fingerprints is split by a hash into parts, and each pair of parts is a task's work
of its own: no task ever holds more than two parts, and every pair still meets. Components come from the forests by
large-star and small-star steps, whose state is a table in the shared folder.

``deduplicated``, which needs no contract's fingerprint, takes candidates as above from fingerprints of texts' distinct
words, and verifies them by the exact similarity of their sets of five-word shingles, component by component.

Null and empty texts have the fingerprint zero and link like any other. Null doc_ids take part and count for no
component's name, unless all of it are null. Repeated rows keep one row each. A bit that half the shingles set is zero.
Of a very long text the hashes of its shingles are held. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import WordHasher, few, joined_by, lean, pieces, slices, table, texts, written
from quillspark.llm.decontam import shingles

SHINGLE_WORDS = 4
RADIUS = 4
PIVOTS = 24
FILE_ROWS = 4096
#: Files of so many rows or fewer are looked at together.
SMALL = 64
#: Edges that a node of a star may have before its join is split off.
HUB = 100_000
#: Bits in which fingerprints of distinct words may differ, and texts of a component that are compared in one task.
WORD_RADIUS, MEMBERS = 8, 2048
LOWER = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text's words in lower case (A-Z only), as unsigned 64-bit integers."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip((ends - lens)[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64-bit) of each row of ``docs`` (doc_id, text)."""

    def prints(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (some for frame in lean(frames) for some in slices(frame)):
            found = [fingerprint(shingle_hashes(t)) for t in texts(frame)]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())], schema=PRINTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id bigint, fp bigint")


def pivots() -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(7).integers(0, 1 << 64, PIVOTS, np.uint64, endpoint=False)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances (rows: fingerprints, columns: references)."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)


def forest(prints: np.ndarray, part: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions in ``prints``) that span the components of one file.

    ``part``: pairs within a part are looked for elsewhere if there are two of them; -1: all pairs count.
    """
    rows = distance_table(prints)
    order = np.argsort(rows[:, 0], kind="stable")
    prints, rows, part = prints[order], rows[order], part[order]
    stop = np.searchsorted(rows[:, 0], rows[:, 0] + radius, side="right")
    root = np.arange(len(prints))
    out: list[tuple[int, int]] = []
    for i in range(len(prints) - 1):
        near = np.arange(i + 1, stop[i])
        near = near[(root[near] != root[i]) & ((part[near] != part[i]) | (part[i] < 0))]
        if len(near):
            near = near[np.abs(rows[near] - rows[i]).max(axis=1) <= radius]
            near = near[np.bitwise_count(prints[near] ^ prints[i]) <= radius]
            for j in near.tolist():
                if root[j] != root[i]:
                    out.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
    return out


class Roots:
    """Which of some things are linked by way of others."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        """Link two; False if they were."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[a] = b
        return a != b


def small_files(file: np.ndarray, part: np.ndarray, rows: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of many small files at once, which lie one after another, sorted by the first pivot in each.

    Each row meets the ones after it in its file, a place further at a time, while the first pivot allows it.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at, d = np.arange(len(file)), 1
    while len(at := at[at + d < len(file)]):
        at = at[(file[at] == file[at + d]) & (rows[at + d, 0] - rows[at, 0] <= radius)]
        near = at[(part[at] != part[at + d]) | (part[at] < 0)]
        near = near[np.abs(rows[near] - rows[near + d]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(prints[near] ^ prints[near + d]) <= radius]
        found.append((near, near + d))
        d += 1
    a, b = (np.concatenate(x) for x in zip(*found))
    roots = Roots()
    keep = np.fromiter((roots.link(x, y) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
    return a[keep], b[keep]


def groups(frames: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int = 1) -> Iterator[list[pa.Array]]:
    """Columns of batches that are sorted by the first of them, cut so that no value of it is cut. At least ``size`` rows, but at the end."""
    held: list[list[pa.Array]] = []
    n = 0

    def taken() -> list[pa.Array]:
        return [pa.concat_arrays(list(x)) for x in zip(*held)]

    for frame in frames:
        if frame.num_rows:
            held.append([frame.column(k) for k in names])
            n += frame.num_rows
        if n >= size and len(held):
            columns = taken()
            key = columns[0].to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(key, key[-1]))
            held = [[c.slice(last) for c in columns]]
            if last:
                n -= last
                yield [c.slice(0, last) for c in columns]
    if n:
        yield taken()


def _file_links(radius: int):
    """Rows (file, part, fp), sorted by file, to the links of each file."""

    def links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(frames, ("file", "part", "fp"), 1 << 14):
            file, part, fp = (c.to_numpy(zero_copy_only=False) for c in columns)
            cut = np.flatnonzero(np.r_[True, file[1:] != file[:-1], True])
            size = np.diff(cut)
            found = []
            for a, b in zip(cut[:-1][size > SMALL].tolist(), cut[1:][size > SMALL].tolist()):
                if pairs := forest(fp[a:b].view(np.uint64), part[a:b], radius):
                    x, y = np.array(pairs).T
                    found.append((fp[a:b][x], fp[a:b][y]))
            small = np.flatnonzero(np.repeat((size <= SMALL) & (size > 1), size))
            if len(small):
                rows = distance_table(fp[small].view(np.uint64))
                order = np.lexsort((rows[:, 0], file[small]))
                rows, small = rows[order], small[order]
                x, y = small_files(file[small], part[small], rows, fp[small].view(np.uint64), radius)
                found.append((fp[small][x], fp[small][y]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=LINKS)

    return links


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For every choice of ``blocks - radius`` blocks, their bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    bits = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The number of blocks that makes the least work of ``n`` fingerprints: rows of files, and pairs at a hundredth of a row each."""

    def work(blocks: int) -> float:
        return comb(blocks, radius) * (1 + n / 2 ** (64 * (blocks - radius) // blocks) / 2 / 100)

    return min(range(radius + 2, radius + 7), key=work)


def dealt(rows: DataFrame, limit: int, key: str) -> DataFrame:
    """Rows with a column ``file``: those of a file of more than ``limit`` rows are dealt to pairs of parts, by a hash of ``key``.

    The new column ``part`` is -1 where all pairs of a file are looked at, and else the part: pairs within it are looked
    at elsewhere. A file of n rows becomes files of 2 * ``limit`` rows or so, n / ``limit`` rows for each of its own.
    """
    large = rows.groupBy("file").count().where(F.col("count") > limit).select(F.col("file").alias("big"), F.ceil(F.col("count") / limit).cast("long").alias("parts"))
    # a part i of a large file meets each part j: the two go to a file named after both
    mine = F.pmod(F.xxhash64(key, F.lit(1)), F.col("parts"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.when(j == mine, F.struct(F.xxhash64("file", mine, mine).alias("file"), F.lit(-1).cast("long").alias("part"))).otherwise(F.struct(F.xxhash64("file", F.least(j, mine), F.greatest(j, mine)).alias("file"), mine.alias("part"))))
    whole = F.array(F.struct(F.col("file"), F.lit(-1).cast("long").alias("part")))
    others = [c for c in rows.columns if c != "file"]
    return rows.join(large, rows.file == large.big, "left").select(*others, F.explode(F.when(F.col("parts").isNull(), whole).otherwise(meets)).alias("_")).select("_.file", "_.part", *others)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``distinct`` (fp) that span their components."""
    masks = block_masks(blocks_for(distinct.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # the file's name holds which choice it is: different choices never meet
    names = F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("file")) for k, m in enumerate(signed)])
    filed = distinct.select("fp", F.explode(names).alias("_")).select("fp", "_.file")
    found = dealt(filed, FILE_ROWS, "fp").repartition("file").sortWithinPartitions("file").mapInArrow(_file_links(radius), "a bigint, b bigint")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node that it is connected to.

    Large-star and small-star steps alternate until the edges no longer change. The nodes of a star meet by a
    minimum and a join, in which a star's hub of many edges is broadcast; no adjacency list is ever gathered.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        joined = joined_by(both, least, "a", 2 * n, HUB)
        if large:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now, seen = written(edges.select("a", "b").where("a <> b"), "links"), None
    n = now.count()
    while True:
        now = written(star(star(now, True, n), False, n), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


def rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, n, first_id, root) of the distinct fingerprints of ``prints`` (doc_id, fp): how many rows have it, their least doc_id, and the component."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    return written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of the document's component, for each row of ``docs``."""
    prints = written(fingerprints(docs), "prints")
    named = rooted(prints, radius)
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_print = written(joined_by(named.select("fp", "root", F.col("n").alias("rows")), names, "root", named.count()).select("fp", F.col("rows").alias("n"), "component_id"), "named")
    return joined_by(prints, by_print, "fp", prints.count()).select("doc_id", "fp", "component_id")


def word_prints(column: pa.Array) -> Iterator[int]:
    """For each text of a column the majority of each bit over its distinct words, in lower case (A-Z only)."""
    hasher = WordHasher(LOWER)
    for _, _, data, edges in pieces(column):
        _, _, words, cut = hasher(data, edges)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield fingerprint(np.unique(words[a:b]))


def word_shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text of a column the distinct hashes of its shingles of ``n`` words (all words of a shorter text; a hash of its own for no words)."""
    hasher = WordHasher(LOWER)
    for _, _, data, edges in pieces(column):
        _, _, words, cut = hasher(data, edges)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield np.unique(shingles(words[a:b], min(n, b - a))) if b > a else np.zeros(1, np.uint64)


def spanning(sets: list[np.ndarray], part: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links (positions) that span what ``sets`` are connected by pairs of a Jaccard similarity of ``similar`` or more; ``part`` as in ``forest``."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    postings = owner[np.argsort(name, kind="stable")]
    upto = np.cumsum(np.bincount(name))
    begin, first = np.r_[0, upto[:-1]], np.cumsum(size) - size
    open_, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue and open_.any():
            i = queue.pop()
            mine = name[first[i] : first[i] + size[i]]
            n = upto[mine] - begin[mine]
            held = postings[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            both = np.bincount(held, minlength=len(sets))
            near = np.flatnonzero(open_ & (both >= similar * (size + size[i] - both)) & ((part != part[i]) | (part[i] < 0)))
            open_[near] = False
            out += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return out


def verified(members: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the texts of ``members`` (file, digest, shingles) that span what is similar within a file."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, part, name, sets in groups(frames, ("file", "part", "digest", "shingles")):
            file, part = file.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False)
            values, edges = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
            cut = np.flatnonzero(np.r_[True, file[1:] != file[:-1], True])
            found = [(a + i, a + j) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a > 1 for i, j in spanning([values[edges[k] : edges[k + 1]] for k in range(a, b)], part[a:b], similar)]
            if found:
                yield pa.RecordBatch.from_arrays([name.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)], names=["a", "b"])

    return dealt(members, MEMBERS, "digest").repartition("file").sortWithinPartitions("file").select("file", "part", "digest", "shingles").mapInArrow(of, "a binary, b binary")


def near_copies(docs: DataFrame, similar: float = 0.8, n: int = 5, radius: int = WORD_RADIUS) -> DataFrame:
    """(digest, doc_id, root): every different text of ``docs`` (doc_id, digest, text) with its least doc_id, and the text it counts as a copy of.

    Fingerprints of distinct words, within ``radius`` bits of each other, make components as in ``near_duplicates``: a
    text's words hardly change where a word in twenty is replaced, while a fifth of its shingles do. Inside a component
    the texts' sets of ``n``-word shingles are compared, and pairs of a similarity of ``similar`` or more link.
    """

    def prints(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (some for frame in lean(frames) for some in slices(frame)):
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("digest"), pa.array(word_prints(frame.column("text")), pa.int64())], names=["doc_id", "digest", "fp"])

    keyed = written(docs.mapInArrow(prints, "doc_id bigint, digest binary, fp bigint"), "word-prints")
    texts_ = written(keyed.groupBy("digest", "fp").agg(F.min("doc_id").alias("doc_id")), "texts")
    named = rooted(texts_, radius)
    # components of one text need no comparison
    sizes = named.groupBy("root").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("n"))
    several = written(joined_by(named.select("fp", "root", F.col("n").alias("rows")), sizes, "root", named.count()).where("texts > 1").select("fp", "root", F.col("rows").alias("n")), "several")
    members = few(joined_by(texts_, several, "fp", texts_.count()).select("digest", "doc_id", "root"), "members", 200_000)

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (some for frame in lean(frames) for some in slices(frame)):
            sets = [x.view(np.int64) for x in word_shingles(frame.column("text"), n)]
            edges = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([frame.column("file"), frame.column("digest"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(sets)))], names=["file", "digest", "shingles"])

    wanted = docs.join(members, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select(F.col("root").alias("file"), "digest", "text")
    sets = written(wanted.mapInArrow(cut, "file bigint, digest binary, shingles array<bigint>"), "shingle-sets")
    roots = components(verified(sets, similar))
    return texts_.join(roots, texts_.digest == roots.node, "left").select("digest", "doc_id", F.coalesce("root", "digest").alias("root"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near copies: of each group the row of the least doc_id stays, of several such the one of the least text digest.

    A row without doc_id stays, as nothing tells which one it is; of repeated rows of the staying document one stays.
    """
    # packed, so no column's name matters
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text", F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    known = packed.where(F.col("doc_id").isNotNull())
    found = near_copies(known.select("doc_id", "digest", "text"), **options)
    staying = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("_")).select("_.*")
    kept = known.select("doc_id", "digest", "doc").join(staying, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.select("doc.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
