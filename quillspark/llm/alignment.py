"""Operator 11, alignment of two tokenizers: segment deduplication.

Texts are cut before runs of white space. That is done only where neither vocabulary can merge across, which is read
from the vocabularies: before such white space as follows no other character inside any entry, and behind a character
that is certainly no white space (else the byte-level pattern could look on). Segments then mean the same tokens
wherever they stand. Spark counts the distinct segments of the corpus; each is tokenised and aligned once, thousands
of them in one call. Links of distinct segments, times their counts, are the links of the corpus.

Documents are composed from their segments' alignments. The commonest ``HEAD`` segments are broadcast; each block of
documents asks for the others it has, each once, by a join, and gets them with the block. What is joined is therefore
neither texts nor every word, but the rare distinct segments of a block; no key of the join is common, for common
segments are broadcast.

Tokenizer A is byte-level BPE (the ``tokenizers`` library), B is SentencePiece BPE with byte fallback and no
normalisation; others are refused. Both have bytes for anything, so B's bytes differ from the text only where the text
has U+2581 itself, which B reads as a space: such texts have no tokens, as null and empty ones. A null doc_id is kept.
Repeated rows keep one row each and count as often as they come. Links tied for a B id's highest count are all best.
A very long text is cut, hashed and composed a piece at a time; its block holds four bytes a segment and its rare
segments' alignments. Segments are known by 64-bit hashes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BLANK, head_from, joined_by, lean, mixed, pieces, table, written

#: Segments whose alignments are broadcast (some 60 bytes each), and pairs of ids that are (17 bytes each).
HEAD, MOST_PAIRS = 1 << 19, 1 << 21
#: Distinct segments that a task holds before it hands them on, bytes of text cut at a time, bytes of text of a block.
HELD, PIECE, BLOCK_BYTES = 1 << 19, 1 << 20, 1 << 20
SLICE = 1 << 17

SEGMENTS = "segment binary, n bigint"
ALIGNED = "h bigint, n bigint, n_a int, n_b int, groups binary, links array<bigint>"
SCORED = "h bigint, n bigint, n_a int, n_b int, n_groups int, n_best int, count_sum bigint, groups binary"
BLOCKS = "block bigint, doc_ids array<bigint>, sizes array<bigint>, slots binary, rare array<bigint>"
ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_VALUES = np.random.default_rng(23).integers(0, 1 << 64, 64 * 256, np.uint64)


def _pool(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries one after another: bytes, where each begins, how long each is."""
    lens = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lens) - lens, lens


def gathered(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``pool[start:start + len]`` of each, one after another."""
    upto = np.cumsum(lens)
    return pool[np.repeat(starts - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]


class Pair:
    """Two tokenizers, their vocabularies' bytes, and where texts may be cut."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        told = json.loads(self.a.to_str())
        before = told["pre_tokenizer"] or {}
        if told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("tokenizer A isn't plain byte-level BPE")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        words = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in words]
        names = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_pool, self.b_pool = _pool(self.a_bytes), _pool(self.b_bytes)
        self.lead = [self.b.piece_to_id("▁"), next((k for k in range(len(self.b)) if self.b.is_byte(k) and names[k] == "<0x0A>"), -1)]
        entries = [*self.a_bytes, *self.b_bytes]
        # white space that follows anything but white space inside an entry; of a broken character nothing is known
        crossed = {e[k] for e in entries for k in range(1, len(e)) if BLANK[e[k]] and not e[:k].decode("utf-8", "replace")[-1].isspace()}
        if self.b.encode("\nx")[:2] != self.lead or any(b"\n" in e and len(e) > 1 for e in self.b_bytes) or 0x20 in crossed:
            raise ValueError("tokenizer B merges across lines or words")
        self.cut = BLANK.copy()  # white space before which a text may be cut
        self.cut[[*crossed]] = False

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where UTF-8 ``data`` may be cut: before white space of the right kind, behind what is certainly none.

        Of characters beyond ASCII only those whose first bytes no white space shares are certain.
        """
        at = np.flatnonzero(self.cut[data[1:]]) + 1
        back = lambda k: np.where(at >= k, data[np.maximum(at - k, 0)], 0)
        one, two, three, four = back(1), back(2), back(3), back(4)
        tail = (one & 0xC0) == 0x80
        two_bytes = tail & (two >= 0xC3) & (two < 0xE0)
        three_bytes = tail & ((two & 0xC0) == 0x80) & (three >= 0xE3) & (three < 0xF0) & ~((three == 0xE3) & (two == 0x80))
        four_bytes = tail & ((two & 0xC0) == 0x80) & ((three & 0xC0) == 0x80) & (four >= 0xF0)
        return at[((one > 0x20) & (one < 0x7F)) | two_bytes | three_bytes | four_bytes]

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Texts of a column of non-empty texts, each with a space before it, as ``pieces``; a very long one in several, cut where it may be."""
        for a, b, data, edges in pieces(column, PIECE):
            if b - a > 1 or len(data) <= 2 * PIECE:
                yield a, b, np.insert(data, edges[:-1], 0x20), edges + np.arange(len(edges))
                continue
            at, lead = 0, np.array([0x20], np.uint8)
            while at < len(data):
                step = PIECE
                while at + step < len(data):
                    places = self.cuts(data[at : at + step])
                    places = places[places >= 4]
                    if len(places):
                        step = int(places[-1])
                        break
                    step += PIECE
                part = np.concatenate([lead, data[at : at + step]])
                yield a, b, part, np.array([0, len(part)])
                at, lead = at + step, lead[:0]

    def segments(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where segments begin, their hashes, and the edges counted in segments."""
        begins = np.union1d(edges[:-1], self.cuts(data))
        return begins, self.hashes(data, begins), np.searchsorted(begins, edges)

    @staticmethod
    def hashes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Hashes of the segments that begin there and fill ``data``."""
        place = np.arange(len(data)) - np.repeat(begins, np.diff(np.r_[begins, len(data)]))
        value = _VALUES[((place & 63) << 8) | data]
        far = np.flatnonzero(place >= 64)
        if len(far):
            value[far] = mixed(value[far] + (place[far] >> 6).astype(np.uint64))
        sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)][np.r_[begins, len(data)]]
        lens = np.diff(np.r_[begins, len(data)]).astype(np.uint64)
        return mixed(np.diff(sums) + lens)

    def align(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Alignments of the segments that lie in ``data`` from edge to edge, and that may follow each other so.

        Ids of A and B in each; groups in each; the groups as text, and its edges; the links of all groups.
        """
        text = data.tobytes().decode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode("\n" + text)[2:], np.int64)
        for ids, pool in ((a, self.a_pool), (b, self.b_pool)):
            if not np.array_equal(gathered(pool[0], pool[1][ids], pool[2][ids]), data):
                raise ValueError("a tokenizer's bytes aren't the text's")
        a_end, b_end = np.cumsum(self.a_pool[2][a]), np.cumsum(self.b_pool[2][b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        groups = np.searchsorted(common, edges, side="right")
        if not np.isin(edges[1:], common).all():
            raise ValueError("a token crosses a segment's end")
        of_a, of_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        # ids in the order of the text: group by group, A's before B's, each with the mark that follows it
        order = np.argsort(np.r_[2 * of_a, 2 * of_b + 1], kind="stable")
        last_a, last_b = np.isin(a_end, common), np.isin(b_end, common)
        marks = np.r_[np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))].astype(np.uint8)[order]
        ids = np.r_[a, b][order]
        text_lens = _DIGITS[2][ids] + 1
        out = np.zeros(int(text_lens.sum()), np.uint8)
        ends = np.cumsum(text_lens)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = gathered(_DIGITS[0], _DIGITS[1][ids], _DIGITS[2][ids])
        out[ends - 1] = marks
        n_a, n_b = np.searchsorted(a_end, edges, side="right"), np.searchsorted(b_end, edges, side="right")
        links = (a[last_a] << 32) | b[last_b]
        return np.diff(n_a), np.diff(n_b), np.diff(groups), out, np.r_[0, ends][n_a + n_b], links

    def alone(self, segments: list[bytes]) -> np.ndarray:
        """Which segments don't end in a character behind which texts are cut."""
        if not segments:
            return np.zeros(0, bool)
        data, starts, lens = _pool([s + b" " for s in segments])
        return ~np.isin(starts + lens - 1, self.cuts(data))


_DIGITS = _pool([str(k).encode() for k in range(1 << 16)])
_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(files: tuple[str, str]) -> Pair:
    """This worker's tokenizers."""
    if files not in _pairs:
        _pairs.clear()
        _pairs[files] = Pair(*files)
    return _pairs[files]


def binary(pool: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(pool))]).cast(pa.binary())


def _whole(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows whose texts have tokens, and these texts."""
    column = pc.fill_null(column, "")
    rows = np.flatnonzero(pc.and_(pc.greater(pc.binary_length(column), 0), pc.invert(pc.match_substring(column, "▁"))).to_numpy(zero_copy_only=False))
    return rows, column.take(pa.array(rows))


def distinct_segments(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(segment, n): the distinct segments of all texts and how often they come."""

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        known, slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and which of the held they are
        bytes_: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        counts = np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            if not len(counts):
                return
            size, pool = np.concatenate(lens), np.concatenate(bytes_)
            edges = np.r_[0, np.cumsum(size)]
            for k in range(0, len(size), 1 << 16):
                m = min(k + (1 << 16), len(size))
                yield pa.RecordBatch.from_arrays([binary(pool[edges[k] : edges[m]], edges[k : m + 1] - edges[k]), pa.array(counts[k:m])], names=["segment", "n"])

        for frame in lean(frames):
            _, column = _whole(frame.column("text"))
            for _, _, data, edges in pair.chunks(column):
                begins, h, _ = pair.segments(data, edges)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                old = known[at] == u if len(known) else np.zeros(len(u), bool)
                counts[slot[at[old]]] += n[old]
                new = ~old
                start, stop = begins[first[new]], np.r_[begins[1:], len(data)][first[new]]
                lens.append(stop - start)
                bytes_.append(gathered(data, start, stop - start))
                merged, slots = np.concatenate([known, u[new]]), np.concatenate([slot, len(counts) + np.arange(int(new.sum()))])
                order = np.argsort(merged, kind="stable")
                known, slot = merged[order], slots[order]
                counts = np.concatenate([counts, n[new]])
                if len(counts) >= HELD:
                    yield from rows()
                    known, slot, counts = known[:0], slot[:0], counts[:0]
                    bytes_, lens = [], []
        yield from rows()

    return docs.select("text").mapInArrow(found, SEGMENTS).groupBy("segment").agg(F.sum("n").alias("n"))


def aligned(segments: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Each distinct segment's numbers of ids, its groups as text, and its links, one a group: A's id * 2^32 + B's."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for frame in lean(frames):
            for k in range(0, frame.num_rows, 4096):
                some = frame.slice(k, 4096)
                each = some.column("segment").to_pylist()
                alone = pair.alone(each)
                together = np.flatnonzero(~alone)
                for which in [together, *([x] for x in np.flatnonzero(alone))]:
                    if not len(which):
                        continue
                    data, starts, lens = _pool([each[x] for x in which])
                    n_a, n_b, n, text, edges, links = pair.align(data, np.r_[starts, len(data)])
                    # a segment's text without the mark behind its last group
                    keep = np.ones(len(text), bool)
                    keep[edges[1:] - 1] = False
                    groups = binary(text[keep], edges - np.arange(len(edges)))
                    yield pa.RecordBatch.from_arrays([pa.array(pair.hashes(data, starts).view(np.int64)), some.column("n").take(pa.array(which)), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()), groups, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(links))], names=["h", "n", "n_a", "n_b", "groups", "links"])

    return segments.mapInArrow(rows, ALIGNED)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(link, count, best): how many links of the corpus join two ids, and whether none joins that B id more often."""
    counted = alignments.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count"))
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    counted = written(counted.withColumn("b", b), "link-counts")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(alignments: DataFrame, pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``alignments`` with n_best and count_sum for their links instead of the links.

    Pairs that are counted to be few are broadcast; else links meet them by a join, the commonest ones broadcast.
    """
    pairs = written(pairs, "links")
    if pairs.count() > most_pairs:
        each = written(alignments.select("h", F.explode("links").alias("link")), "link-rows")
        told = pairs.join(each.groupBy("link").count().withColumnRenamed("count", "n"), "link")
        sums = joined_by(each, told, "link", each.count()).groupBy("h").agg(F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        return alignments.join(sums, "h").select("h", "n", "n_a", "n_b", F.size("links").alias("n_groups"), "n_best", "count_sum", "groups")
    held = pairs.orderBy("link").toArrow()
    sent = alignments.sparkSession.sparkContext.broadcast(tuple(held.column(k).to_numpy() for k in ("link", "count", "best")))

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, best = sent.value
        for frame in lean(frames):
            links = frame.column("links")
            edges = links.offsets.to_numpy() - links.offsets[0].as_py()
            at = np.searchsorted(link, links.flatten().to_numpy())
            upto = lambda x: np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][edges])
            yield pa.RecordBatch.from_arrays([*(frame.column(k) for k in ("h", "n", "n_a", "n_b")), pa.array(np.diff(edges), pa.int32()), pa.array(upto(best[at]), pa.int32()), pa.array(upto(count[at])), frame.column("groups")], names=["h", "n", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups"])

    return alignments.mapInArrow(rows, SCORED)


NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def packed(slots: np.ndarray) -> bytes:
    """Slots, the common ones small, as four planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(slots.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Known:
    """Scored segments in the order in which they are given: numbers, and texts one after another. ``order`` sorts their hashes."""

    def __init__(self, rows: pa.Table | pa.StructArray | None):
        field = (lambda k: rows.field(k)) if isinstance(rows, pa.StructArray) else (lambda k: rows.column(k).combine_chunks())
        h = np.zeros(0, np.uint64) if rows is None else field("h").to_numpy().view(np.uint64)
        self.order = np.argsort(h)
        self.h = h[self.order]
        self.numbers = np.stack([np.zeros(0, np.int64) if rows is None else field(k).to_numpy().astype(np.int64) for k in NUMBERS])
        texts = pa.array([], pa.large_binary()) if rows is None else field("groups").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.pool = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        self.starts, self.lens = edges[:-1], np.diff(edges)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, -1 where there is none."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.order[at], -1)


def blocks(docs: DataFrame, head, files: tuple[str, str]) -> DataFrame:
    """Blocks of documents as their segments: places in the head, or below 0 in the block's rare ones, each of which it names once."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known, part, k = pair_of(files), head.value, TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        hashes: list[np.ndarray] = []
        weight = 0

        def block() -> pa.RecordBatch:
            nonlocal ids, sizes, hashes, weight, k
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            slots = known.find(h)
            rare, which = np.unique(h[slots < 0], return_inverse=True)
            slots[slots < 0] = -1 - which
            row = (part << 32) + k, ids, sizes, packed(slots), rare.view(np.int64).tolist()
            ids, sizes, hashes, weight, k = [], [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())))], names=["block", "doc_ids", "sizes", "slots", "rare"])

        for frame in lean(frames):
            each = frame.column("doc_id").to_pylist()
            whole, column = _whole(frame.column("text"))
            n, at = np.zeros(len(whole), np.int64), 0  # segments of each whole text, and the next row of the frame
            for a, b, data, edges in pair.chunks(column):
                if weight >= BLOCK_BYTES and a > 0 and n[a] == 0:  # texts before this one are complete
                    stop = int(whole[a])
                    ids, sizes = ids + each[at:stop], sizes + _sizes(n, whole, at, stop)
                    at = stop
                    yield block()
                _, h, upto = pair.segments(data, edges)
                hashes.append(h)
                n[a:b] += np.diff(upto)
                weight += len(data)
            ids, sizes = ids + each[at:], sizes + _sizes(n, whole, at, len(each))
            if weight >= BLOCK_BYTES:
                yield block()
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, BLOCKS)


def _sizes(n: np.ndarray, whole: np.ndarray, start: int, stop: int) -> list[int]:
    out = np.zeros(stop - start, np.int64)
    i, j = np.searchsorted(whole, [start, stop])
    out[whole[i:j] - start] = n[i:j]
    return out.tolist()


def composed(cut: DataFrame, rare: DataFrame, head) -> DataFrame:
    """Documents of blocks, from the head and from what ``rare`` has for each block's rare segments."""
    asked = cut.select("block", F.explode("rare").alias("h")).join(rare, "h")
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("h", *NUMBERS, "groups")).alias("found"))

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = head.value
        for frame in lean(frames):
            for r in range(frame.num_rows):
                ids, sizes = (frame.column(k)[r].as_py() for k in ("doc_ids", "sizes"))
                found = frame.column("found")[r]
                yield _composed(ids, np.array(sizes, np.int64), unpacked(frame.column("slots")[r].as_py()), common, Known(found.values if found.is_valid else None))

    return cut.select("block", "doc_ids", "sizes", "slots").join(answers, "block", "left").drop("block").mapInArrow(rows, ROWS)


def _composed(ids: list, sizes: np.ndarray, slots: np.ndarray, head: Known, rare: Known) -> pa.RecordBatch:
    numbers = np.zeros((len(NUMBERS), len(sizes)), np.int64)
    digests: list = [None] * len(sizes)
    ends = np.cumsum(sizes)
    for k in range(0, len(slots), SLICE):
        own = slots[k : k + SLICE].astype(np.int64)
        common = own >= 0
        values = np.zeros((len(NUMBERS), len(own)), np.int64)
        starts, lens = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for which, of, at in ((common, head, own[common]), (~common, rare, rare.order[-1 - own[~common]])):
            values[:, which] = of.numbers[:, at]
            starts[which], lens[which] = of.starts[at], of.lens[at]
        upto = np.cumsum(lens + 1)
        out = np.full(int(upto[-1]), ord(";"), np.uint8)
        keep = np.ones(len(out), bool)
        keep[upto - 1] = False
        side = np.repeat(common, lens)
        text = np.zeros(len(side), np.uint8)
        text[side] = gathered(head.pool, starts[common], lens[common])
        text[~side] = gathered(rare.pool, starts[~common], lens[~common])
        out[keep] = text
        first, last = np.searchsorted(ends, [k, k + len(own) - 1], side="right")
        sums = np.concatenate([np.zeros((len(NUMBERS), 1), np.int64), np.cumsum(values, axis=1)], axis=1)
        at = np.r_[0, upto]
        raw = out.tobytes()
        for d in np.flatnonzero(sizes[first : last + 1]) + first:
            i, j = max(int(ends[d] - sizes[d]) - k, 0), min(int(ends[d]) - k, len(own))
            numbers[:, d] += sums[:, j] - sums[:, i]
            digests[d] = digests[d] or hashlib.sha256()
            digests[d].update(raw[at[i] : at[j] - (ends[d] - k == j)])
    n_a, n_b, n_groups, n_best, count_sum = numbers
    shas = [x.hexdigest() if x else "" for x in digests]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_a, n_b, n_groups, n_groups, n_best, count_sum)), pa.array(shas, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, head: int = HEAD, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): its ids by either tokenizer, groups, links and their counts."""
    if a_file is None or b_file is None:
        import public_tokenizers

        a_file, b_file = a_file or public_tokenizers.path("byte_bpe_50k.json"), b_file or public_tokenizers.path("piece_bpe_32k.model")
    files = str(a_file), str(b_file)
    alignments = written(aligned(distinct_segments(docs, files), files), "alignments")
    scored = written(with_counts(alignments, pair_counts(alignments), most_pairs), "scored-alignments")
    least = head_from(scored.select("n"), head)
    common = F.floor(4 * F.log2("n")).cast("int") >= least
    held = scored.where(common).orderBy(F.desc("n"), "h").select("h", *NUMBERS, "groups").toArrow()  # head rows at most
    known = docs.sparkSession.sparkContext.broadcast(Known(held))
    del held
    cut = written(blocks(docs, known, files), "segment-blocks")
    return composed(cut, scored.where(~common).select("h", *NUMBERS, "groups"), known)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
