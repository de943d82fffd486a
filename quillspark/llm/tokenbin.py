"""Operator 5, token-id output: fixed-width bit packing.

Every id takes ``bits`` bits, the fewest that hold the vocabulary, least significant bit first, so id ``k`` of a
block starts at bit ``k * bits`` and any slice can be unpacked by numpy alone. Blocks hold whole documents, about
``BLOCK_IDS`` ids each (one long document may make a longer block), and are rows of a Parquet table:

    part, block      place in the global order (ascending doc_id)
    first            ids of this part before the block: the block offset
    n_ids, bits      ids in the block, bits of each
    doc_ids, lens    documents of the block, ids of each
    payload          the packed ids

A Parquet table lets any store that Spark writes to hold the file, and task retries replace each other cleanly.
Texts are encoded after the range sort, so only texts are shuffled, once. Global starts come from the sums of the
parts, one row for each part.

Null text counts as empty; an empty text is the end id alone. A null doc_id comes first. Repeated doc_ids keep one
row each, side by side; rows that tie in doc_id follow each other by text. A very long text is encoded some MB at a
time, cut behind blanks. An empty table makes no block. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WordHasher, lean, new_path, parts, table

BLOCK_IDS = 1 << 16
#: Chunks, and parts of chunks, that a generation of a worker's memory holds. There are two generations: a full one is
#: kept until the next is full, and what is asked for meanwhile goes over, so that only what is rare is worked out again.
CACHE_CHUNKS, CACHE_PARTS = 400_000, 200_000

BLOCKS = "part int, block int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, lens array<bigint>, payload binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())])
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (unsigned 32-bit) at ``bits`` bits each."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, reading only their bytes."""
    n, skip = stop - start, start * bits % 8
    raw = np.frombuffer(payload, np.uint8)[start * bits // 8 : (stop * bits + 7) // 8]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(raw, bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    return np.packbits(wide.ravel(), bitorder="little").view("<u4")


class ChunkEncoder:
    """A tokenizer for blank-separated chunks, which remembers their parts.

    Holds for tokenizers that drop white space and never join across it, as the given word BPE does: encoding the
    chunks apart then equals encoding the text. Many chunks are encoded in one call, divided by a special token; a
    chunk that has this token's text in it is encoded by itself. A chunk of letters and closing marks is
    looked up as these two, so that ``Word,`` and ``word`` share their work; plain letters go straight to the
    library's merge model, for which the other steps change nothing. Probes at the start switch both shortcuts off
    for a tokenizer that treats such chunks otherwise.
    """

    MARKS = b".,;:!?$%&*#"

    def __init__(self, file: str, divider: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.divider, self.divider_id = divider, self.tokenizer.token_to_id(divider)
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.old_parts: dict[bytes, bytes] = {}
        # the characters that stand for bytes in the vocabulary: themselves if they can be seen, else from 256 on
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.plain = all(self._ids(a + b) == self._merged(a.lower()) + self._ids(b) for a, b in (("Hello", ",.!?"), ("ab", "$%&*#"), ("Extraordinarily", ";:")))
        shown = "\u00e9t\u00ff\u0159".encode().decode("latin-1").translate(self.shown)
        self.split = self.plain and self._ids("\u00c9t\u0178\u0158!") == self._merged(shown) + self._ids("!")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _encode_apart(self, pieces: list[bytes]) -> None:
        """Add ``pieces`` to the parts, many in one call."""
        mark = self.divider.encode()
        even = [p for p in pieces if self.divider_id is not None and mark not in p]
        for p in set(pieces).difference(even):
            self.parts[p] = self._ids(p.decode())
        for k in range(0, len(even), 128):
            part = even[k : k + 128]
            ids = np.array(self.tokenizer.encode_batch_fast([self.divider.join([p.decode() for p in part])], add_special_tokens=False)[0].ids, "<u4")
            raw, a = ids.tobytes(), 0
            for p, b in zip(part, [*np.flatnonzero(ids == self.divider_id).tolist(), len(ids)]):
                self.parts[p] = raw[4 * a : 4 * b]
                a = b + 1

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        if len(self.parts) > CACHE_PARTS:
            self.old_parts, self.parts = self.parts, {b"": b""}
        parts, old, marks = self.parts, self.old_parts, self.MARKS

        def unknown(part: bytes) -> bool:
            if part in parts:
                return False
            if (ids := old.get(part)) is not None:
                parts[part] = ids
            return ids is None

        cut: list[tuple[bytes, bytes]] = []
        missing: list[bytes] = []
        for c in chunks:
            core = c.rstrip(marks)
            tail = c[len(core) :]
            if core.isalpha() and self.plain:  # A to Z only
                core = core.lower()
                if unknown(core):
                    parts[core] = self._merged(core.decode())
            elif self.split and core and (letters := core.decode()).isalpha():
                if unknown(core):
                    if max(letters) < "\u0250" and "\u0130" not in letters:  # composed, and lower case letter by letter
                        parts[core] = self._merged(letters.lower().encode().decode("latin-1").translate(self.shown))
                    else:
                        missing.append(core)
            else:
                core, tail = c, b""
                if unknown(core):
                    missing.append(core)
            if unknown(tail):
                missing.append(tail)
            cut.append((core, tail))
        if missing:
            self._encode_apart(list(set(missing)))
        return [parts[core] + parts[tail] for core, tail in cut]


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    upto = np.cumsum(lens)
    return np.repeat(starts - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)


class ChunkTable:
    """Numpy hash table from chunks' 64-bit hashes to their bytes and their ids, which lie in a pool each."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slots = np.zeros(1 << 16, np.int64)
        self.n = self.used = self.written = 0
        self.starts, self.lens, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 17, np.uint32)
        self.begins, self.sizes, self.bytes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 18, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is, or where it would go."""
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes ^ (hashes >> np.uint64(29))) & mask
        open_ = np.arange(len(hashes))
        while len(open_):
            there = self.keys[at[open_]]
            open_ = open_[(there != hashes[open_]) & (there != 0)]
            at[open_] = (at[open_] + np.uint64(1)) & mask
        return at.astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where there is none."""
        at = self._places(hashes)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        while len(hashes):
            at = self._places(hashes)
            self.keys[at] = hashes  # of those that want one place, the last has it
            won = self.keys[at] == hashes
            self.slots[at[won]] = slots[won]
            hashes, slots = hashes[~won], slots[~won]

    def store(self, chunks: list[bytes], ids: list[bytes]) -> np.ndarray:
        """Slots of chunks that are put into the pools, under no hash as yet."""
        pool, raw = np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(chunks), np.uint8)
        return self._store(pool, np.fromiter(map(len, ids), np.int64, len(ids)) // 4, raw, np.fromiter(map(len, chunks), np.int64, len(chunks)))

    def _store(self, pool: np.ndarray, lens: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        twice = lambda x: np.concatenate([x, np.zeros_like(x)])
        while self.used + len(pool) > len(self.pool):
            self.pool = twice(self.pool)
        while self.written + len(raw) > len(self.bytes):
            self.bytes = twice(self.bytes)
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens, self.begins, self.sizes = map(twice, (self.starts, self.lens, self.begins, self.sizes))
        self.pool[self.used : self.used + len(pool)] = pool
        self.bytes[self.written : self.written + len(raw)] = raw
        slots = np.arange(self.n, self.n + len(lens))
        self.starts[slots], self.lens[slots] = self.used + np.cumsum(lens) - lens, lens
        self.begins[slots], self.sizes[slots] = self.written + np.cumsum(sizes) - sizes, sizes
        self.n, self.used, self.written = self.n + len(lens), self.used + len(pool), self.written + len(raw)
        return slots

    def add(self, hashes: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        """Add chunks under their hashes, each of which comes once and is not there yet."""
        self._enter(hashes, self.store(chunks, ids))

    def take_over(self, hashes: np.ndarray, other: ChunkTable, slots: np.ndarray) -> None:
        """As ``add``, of the chunks in another table's slots."""
        lens, sizes = other.lens[slots], other.sizes[slots]
        self._enter(hashes, self._store(other.pool[_places(other.starts[slots], lens)], lens, other.bytes[_places(other.begins[slots], sizes)], sizes))

    def _enter(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        if 2 * self.n > len(self.keys):
            size, full = len(self.keys), self.keys != 0
            while 2 * self.n > size:
                size *= 2
            keys, held = self.keys[full], self.slots[full]
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int64)
            self._put(keys, held)
        self._put(hashes, slots)

    def others(self, slots: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the chunks ``data[begins:ends]`` have other bytes than their slots."""
        sizes = ends - begins
        upto = np.cumsum(sizes)
        along = np.arange(upto[-1] if len(upto) else 0)
        mine = data[np.repeat(begins - (upto - sizes), sizes) + along]
        held = self.bytes[np.minimum(np.repeat(self.begins[slots] - (upto - sizes), sizes) + along, len(self.bytes) - 1)]
        out = self.sizes[slots] != sizes
        out[np.searchsorted(upto, np.flatnonzero(mine != held), side="right")] = True
        return np.flatnonzero(out)


class Encoder:
    """Encodes Arrow's string columns: chunks are cut, hashed and looked up by numpy, new ones go to the library.

    A hash only says where to look: each chunk's bytes are compared with those of the chunk found there, and one that
    shares its hash with another is encoded by itself.
    """

    def __init__(self, file: str):
        self.chunks, self.table, self.hasher = ChunkEncoder(file), ChunkTable(), WordHasher()
        self.old = ChunkTable()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, and how many each text has. Null: none."""
        out, counts = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int64)
        for a, b, data, edges in parts(column):
            ids, n = self._encode(data, edges)
            out.append(ids)
            counts[a:b] += n
        return np.concatenate(out), counts

    def _encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends, hashes, words = self.hasher(data, edges)
        hashes[hashes == 0] = 1
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.table.n + len(distinct) > CACHE_CHUNKS:
            self.old, self.table = self.table, ChunkTable()
        slots = self.table.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new) and self.old.n:
            before = self.old.find(distinct[new])
            kept = before >= 0
            self.table.take_over(distinct[new[kept]], self.old, before[kept])
            new = new[~kept]
            slots = self.table.find(distinct)
        if len(new):
            raw = self._raw(data, begins[first[new]], ends[first[new]])
            self.table.add(distinct[new], raw, self.chunks.ids_of(raw))
            slots = self.table.find(distinct)
        slots = slots[which]
        other = self.table.others(slots, data, begins, ends)
        if len(other):
            raw = self._raw(data, begins[other], ends[other])
            slots[other] = self.table.store(raw, self.chunks.ids_of(raw))
        lens = self.table.lens[slots]
        total = np.r_[0, np.cumsum(lens)]
        ids = self.table.pool[np.repeat(self.table.starts[slots] - total[:-1], lens) + np.arange(total[-1])]
        return ids, np.diff(total[words])

    @staticmethod
    def _raw(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [data[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """This worker's encoder; it lives as long as the worker, over many tasks."""
    if file not in _encoders:
        _encoders.clear()
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _block_writer(file: str, end_id: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block, first = encoder(file), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lens = np.zeros(0, np.int64)
        held = np.zeros(0, np.uint32)

        def cut(n: int) -> pa.RecordBatch:
            """A block of the first n documents held."""
            nonlocal doc_ids, lens, held, block, first
            size = int(lens[:n].sum())
            row = part, block, first, size, bits, doc_ids[:n], lens[:n].tolist(), pack(held[:size], bits)
            doc_ids, lens, held = doc_ids[n:], lens[n:], held[size:]
            first, block = first + size, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, BLOCKS_ARROW)], schema=BLOCKS_ARROW)

        for frame in lean(frames):
            for k in range(0, frame.num_rows, 500):
                some = frame.slice(k, 500)
                ids, n = enc.encode(some.column(1))
                doc_ids += some.column(0).to_pylist()
                held = np.concatenate([held, np.insert(ids, np.cumsum(n), np.uint32(end_id))])
                lens = np.concatenate([lens, n + 1])
                while len(held) >= BLOCK_IDS:
                    yield cut(int(np.searchsorted(np.cumsum(lens), BLOCK_IDS)) + 1)
        if doc_ids:
            yield cut(len(doc_ids))

    return blocks


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to ``path`` in ascending doc_id order."""
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    by_id.mapInArrow(_block_writer(tokenizer, end_id, bits), BLOCKS).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all documents before each. The parts' sums are broadcast: one row for each partition of the write."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    return blocks.join(F.broadcast(starts), blocks.part == starts.p).select(*blocks.columns, (F.col("part_start") + F.col("first")).alias("start"))


def _block_reader(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            ends = np.cumsum(row["lens"])
            begins = ends - np.array(row["lens"])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"], pa.int64()), pa.array(row["lens"], pa.int64()), pa.array(crc, pa.int64())], schema=ROWS_ARROW)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, made from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_blocks(spark, path).select("doc_ids", "lens", "start", "n_ids", "bits", "payload").mapInArrow(_block_reader, ROWS)


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Random access: rows (start, ids) that cover the ids ``start`` to ``stop`` of the whole output, in pieces."""

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                a, b = max(0, start - row["start"]), min(row["n_ids"], stop - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + a], pa.int64()), pa.array([unpack(row["payload"], row["bits"], a, b).tolist()], pa.list_(pa.int64()))], names=["start", "ids"])

    within = (F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)
    return read_blocks(spark, path).where(within).select("start", "n_ids", "bits", "payload").mapInArrow(pieces, "start bigint, ids array<bigint>")


def tokenize_to_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` in the format above into the shared folder, and read the documents' rows back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_path(docs.sparkSession, "ids")
    write(docs, path, str(tokenizer), end_id)
    return read_documents(docs.sparkSession, path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_files(table(spark, sf_dir, "documents"))
