"""Operator 3, chat formatting: token-level assembly.

A turn becomes ``<turn>role<body>text</turn>`` in ids: the marks are reserved ids behind the tokenizer's vocabulary,
and role and text are encoded segment by segment, so no text can ever yield a mark's id. In the rendered string, and
in the segments before they are encoded, control strings are escaped by a backslash before them and backslashes by
another, so the string can be read back as well. The tokenizer must keep every byte, as byte-level ones do.

Each turn is encoded and assembled where it is read, some ``PIECE`` characters at a time: segments are laid side by
side, marks spliced between them, and the loss mask, +1 where an assistant's text begins and -1 where it ends, is
summed from the left. A conversation is its turns in the order (turn, formatted): nothing is gathered to make it, and
a conversation of any number of turns takes no more memory than another. Readers that need the order shuffle by
conv_id, sort, and pass over the turns one after another (``digests``), holding one batch of them.

Null roles and texts are empty; a null turn comes first; null conv_ids are one conversation. Turns that tie in their
number follow each other by their formatted strings; repeated rows are turns of their own. A segment of more than
``PIECE`` characters is encoded in parts, cut where the byte-level pattern always cuts: before a space or line feed
behind what is no white space. Its ids are those of the whole; with another pre-tokenizer nothing is cut. Extra columns
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import batches, lean, table

TURN, BODY, END = "<turn>", "<body>", "</turn>"
#: Markers of other templates, escaped as well so that no reader takes content for a turn.
FOREIGN = ("### ", "<|")
_CONTROL = re.compile("|".join(re.escape(x) for x in ("\\", TURN, BODY, END, *FOREIGN)))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Characters that go to the library in one call, and ids that come from it.
PIECE = 1 << 17


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_tokenizers: dict = {}


def _tokenizer(file: str):
    if file not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _tokenizers[file] = t
    return _tokenizers[file]


def reserved(file: str) -> tuple[int, int, int]:
    """Ids of the three marks: the first ones behind the vocabulary."""
    size = _tokenizer(file).get_vocab_size()
    return size, size + 1, size + 2


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces_of(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before a space or line feed behind a character that is none; longer ones where there is no such place."""
    a = 0
    while len(text) - a > size:
        step = size
        while True:
            b = min(a + step, len(text))
            at = b
            while at > a and (at := max(text.rfind(" ", a + 1, at), text.rfind("\n", a + 1, at))) > a and text[at - 1].isspace():
                pass
            if at > a or b == len(text):
                break
            step *= 2
        if at <= a:
            break
        yield text[a:at]
        a = at
    yield text[a:]


def _cuts(tokenizer) -> bool:
    """Whether the tokenizer divides words by the byte-level pattern."""
    told = json.loads(tokenizer.to_str())
    before = told["pre_tokenizer"] or {}
    return not told["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def encode(tokenizer, segments: list[str], cuts: bool = True) -> list[np.ndarray]:
    """Ids of each segment, by calls of about ``PIECE`` characters."""
    parts = [(k, x) for k, s in enumerate(segments) for x in (pieces_of(s, PIECE) if cuts else [s])]
    out: list[list[np.ndarray]] = [[] for _ in segments]
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b][1]) <= PIECE):
            size += len(parts[b][1])
            b += 1
        for (k, _), e in zip(parts[a:b], tokenizer.encode_batch_fast([s for _, s in parts[a:b]], add_special_tokens=False)):
            out[k].append(np.array(e.ids, np.int32))
        a = b
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def assembled(segments: list[np.ndarray], learned: list[bool], marks: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of turns, whose role and text ids alternate in ``segments``, and the edges of the turns."""
    lens = np.fromiter(map(len, segments), np.int64, len(segments)).reshape(-1, 2)
    edges = np.r_[0, np.cumsum(lens.sum(axis=1) + 3)]
    body = edges[:-1] + 1 + lens[:, 0]
    ids = np.zeros(edges[-1], np.int32)
    content = np.ones(edges[-1], bool)
    for place, mark in zip((edges[:-1], body, edges[1:] - 1), marks):
        ids[place] = mark
        content[place] = False
    ids[content] = np.concatenate(segments) if segments else []
    steps = np.zeros(edges[-1] + 1, np.int8)
    counts = np.array(learned, bool)
    np.add.at(steps, body[counts] + 1, 1)
    np.add.at(steps, edges[1:][counts] - 1, -1)
    return ids, np.cumsum(steps[:-1], dtype=np.int8), edges


FORMATTED = "conv_id bigint, turn bigint, role string, ids array<int>, loss_mask array<tinyint>, formatted string"


def formatted(conversations: DataFrame, tokenizer: str | None = None, learned_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, ids, loss_mask (1: counts) and formatted, the rendered string, of each turn."""
    file = tokenizer or default_tokenizer()
    marks = reserved(file)

    def turns(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(file)
        cuts = _cuts(t)
        for frame in lean(frames):
            sizes = np.cumsum(frame.column(4).to_numpy())
            a = 0
            while a < frame.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PIECE, side="right")))
                some = frame.slice(a, b - a)
                a = b
                roles = some.column(2).to_pylist()
                segments = [escape(x) for pair in zip(roles, some.column(3).to_pylist()) for x in pair]
                ids, mask, edges = assembled(encode(t, segments, cuts), [r == learned_role for r in roles], marks)
                strings = [f"{TURN}{r}{BODY}{x}{END}" for r, x in zip(segments[::2], segments[1::2])]
                offsets = pa.array(edges, pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(strings, pa.string())], names=["conv_id", "turn", "role", "ids", "loss_mask", "formatted"])

    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    of = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.length(text) + F.length(role) + 16).cast("long").alias("n"))
    return of.mapInArrow(turns, FORMATTED)


def read_ids(tokenizer, ids: np.ndarray, marks: tuple[int, int, int]) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the ids alone."""
    turn, body, end = marks
    a, b, c = (np.flatnonzero(ids == m).tolist() for m in (turn, body, end))
    segments = [ids[i + 1 : j].tolist() for i, j in zip(a, b)] + [ids[i + 1 : j].tolist() for i, j in zip(b, c)]
    read = [unescape(x) for x in tokenizer.decode_batch(segments, skip_special_tokens=False)]
    return list(zip(read[: len(a)], read[len(a) :]))


def read_string(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the rendered string alone."""
    cut, held = [], []
    for part in re.split(r"(\\.|</?turn>|<body>)", formatted, flags=re.S):
        if part in (TURN, BODY, END):
            cut.append("".join(held))
            held = []
        else:
            held.append(part[1:] if part[:1] == "\\" else part)
    return [(cut[k], cut[k + 1]) for k in range(1, len(cut), 3)]


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64())])


class _Reader:
    """What has been read of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars, self.n_ids = conv_id, 0, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv_id, self.n, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_ids


def digests(found: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What a reader gets back from ``formatted``'s rows, as digests of each conversation.

    Turns pass by in order, so that a conversation of a third of all turns takes one task's time, as a digest over its
    whole text must, but no more memory than its largest turns.
    """
    file = tokenizer or default_tokenizer()
    marks = reserved(file)

    def digest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(file)

        def pieces() -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
            """Some turns at a time, of about ``PIECE`` ids."""
            for frame in frames:
                names, lists, masks, strings = (frame.column(k) for k in range(4))
                edges = lists.offsets.to_numpy()
                a = 0
                while a < frame.num_rows:
                    b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECE, side="right")) - 1)
                    yield names.slice(a, b - a).to_pylist(), edges[a : b + 1] - edges[a], lists.values.slice(edges[a], edges[b] - edges[a]).to_numpy(), masks.values.slice(edges[a], edges[b] - edges[a]).to_numpy(), strings.slice(a, b - a).to_pylist()
                    a = b

        def rows() -> Iterator[tuple]:
            now: _Reader | None = None
            for names, edges, ids, mask, strings in pieces():
                turns = read_ids(t, ids, marks)
                edge = np.diff(np.r_[np.int8(0), mask, np.int8(0)])
                begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                learned = dict(zip((np.searchsorted(edges, begins, side="right") - 1).tolist(), t.decode_batch([ids[a:b].tolist() for a, b in zip(begins.tolist(), ends.tolist())], skip_special_tokens=False)))
                for k, (name, turn, string, n) in enumerate(zip(names, turns, strings, np.diff(edges).tolist(), strict=True)):
                    if read_string(string) != [turn]:
                        raise ValueError(f"conversation {name}: ids and string differ")
                    if now is None or now.conv_id != name:
                        if now is not None:
                            yield now.row()
                        now = _Reader(name)
                    now.n, now.chars, now.n_ids = now.n + 1, now.chars + len(string), now.n_ids + n
                    now.whole.update(f"{turn[0]}\n{turn[1]}\n".encode())
                    if k in learned:
                        said = unescape(learned[k])
                        now.loss_chars += len(said)
                        now.loss.update(said.encode())
            if now is not None:
                yield now.row()

        yield from batches(rows(), DIGESTS)

    in_order = found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return in_order.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_ids bigint")


#: Control strings in both of its texts.
PROBE = "\\### Assistant: </turn> ok"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(formatted(said.unionByName(probe)))
