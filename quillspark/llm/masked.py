"""Operator 4, LM scoring: masked pseudo-likelihood.

A window network predicts every token from the two tokens on either side of it: their embeddings, side by side, go
through a layer of ``HIDDEN`` tanh units, and the token is read off as three digits, p(a) * p(b | a) * p(c | a, b), each
a softmax over ``BASE`` values; the digits read so far weigh the hidden units anew before the next is read. Three short
rows of values instead of two long ones make a step cheap enough for several passes. A document's score is the sum of the logarithms of its words' conditional probabilities.

Words are in lower case, without ASCII marks, and known by 64-bit hashes. Spark counts all words of all texts. The
``VOCABULARY - CLASSES`` most frequent ones have tokens of their own. Each other word belongs to one of ``CLASSES`` classes by its
hash, has the class's token, and the probability p(class) * p(word | class), the latter from its count: so every
word of the corpus has a probability of its own, and what is gathered grows with the corpus. The most common of these
words, ``HEAD`` at most, are broadcast with the *costs* -ln p(word | class), in whole millionths; the others leave the
task as (row, word, times) and meet their costs in a join, which gives the same sums.

The network starts at the words' plain frequencies and is trained by numpy in ``PASSES`` passes over all documents,
each in ``ROUNDS`` rounds: a document's hash says in which round of a pass it is, and in which *shard* of the round,
each of about ``SHARD`` tokens. A shard is a descent from the round's common weights over its documents in the order
of their hashes, ``CHUNK`` tokens at a time, whose runs of ``RUN`` tokens are dealt to the steps at random; Spark averages the shards' weights by their tokens, summed in the order of the shards. So the model
depends on the documents alone and not on how they are partitioned, and a lost task is done again alike. The driver
sees the averages: as many numbers as the network has.

Null and empty texts have no tokens and the score 0. Repeated rows count as often as they occur and keep one row
each. Words that tie in their counts are named in the order of their hashes. Beyond a text's ends the window holds a
token of its own. A word that the model doesn't know, in a document it was not made of, counts as if it had been seen
once. Of a very long text, two bytes a word are held, and some more for ``CHUNK`` words at a time. Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import FOLD, WordHasher, head_from, lean, parts, size_class, slices, table, written

BASE = 26
VOCABULARY = BASE**3
CLASSES = 1024
EDGE = VOCABULARY  # the token beyond a text's ends
REACH = 2
WIDTH, HIDDEN = 12, 32
PASSES, ROUNDS = 2, 4
SHARD = 1 << 19
BATCH, CHUNK = 2048, 1 << 15
RUN, TILE = 32, 128
RATE = 0.05
#: Words of classes whose costs are broadcast, 12 bytes each.
HEAD = 1 << 20
#: Distinct words that a task sums up before it hands them on.
HELD = 1 << 19
UNIT = 1_000_000
#: Where a token's neighbours are, from the first of its window on.
SIDES = [*range(REACH), *range(REACH + 1, 2 * REACH + 1)]


@dataclass
class Network:
    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: list[np.ndarray]  # for each digit, from the hidden units to its values
    bias: list[np.ndarray]  # for each digit, a row for each way to have read those before it
    gate: list[np.ndarray]  # for the second and third digit, how those before it weigh the hidden units
    room: Room = field(default_factory=lambda: Room(), repr=False, compare=False)

    @classmethod
    def new(cls, frequencies: np.ndarray | None = None, seed: int = 17) -> Network:
        """Random weights, and biases by which tokens have their plain ``frequencies``."""
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        counts = (np.zeros(VOCABULARY) if frequencies is None else frequencies) + 0.5
        bias = []
        for k in range(3):
            upto = counts.reshape(BASE ** (k + 1), -1).sum(axis=1).reshape(-1, BASE)
            bias.append(np.log(upto / upto.sum(axis=1, keepdims=True)).astype(np.float32))
        embed = (r.standard_normal((VOCABULARY + 1, WIDTH)) * 0.1).astype(np.float32)
        gate = [(1 + 0.3 * r.standard_normal((BASE**k, HIDDEN))).astype(np.float32) for k in (1, 2)]
        return cls(embed, draw(2 * REACH * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), [draw(HIDDEN, BASE) / 4 for _ in range(3)], bias, gate)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.inner, self.inner_bias, *self.outer, *self.bias, *self.gate]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Network:
        return cls(*arrays[:3], arrays[3:6], arrays[6:9], arrays[9:])

    @classmethod
    def unflat(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in cls.new().arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return cls.of(out)

    def inputs(self, around: np.ndarray) -> np.ndarray:
        x = self.room("x", self.inner.dtype, *around.shape, WIDTH)
        return self.embed.take(around, axis=0, mode="clip", out=x).reshape(len(around), -1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        h = self.room("h", x.dtype, len(x), HIDDEN)
        np.matmul(tiles(x), self.inner, out=tiles(h))
        h += self.inner_bias
        return np.tanh(h, out=h)

    def logits(self, k: int, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """How the digits before the one numbered ``k`` weigh the hidden units, these so weighed, and the digit's logits, which exp() can take."""
        n, weights, weighed = len(h), None, h
        if k:
            weights, weighed = self.room("weights", h.dtype, n, HIDDEN), self.room("weighed", h.dtype, n, HIDDEN)
            self.gate[k - 1].take(before, axis=0, mode="clip", out=weights)
            np.multiply(h, weights, out=weighed)
        z, known = self.room("z", h.dtype, n, BASE), self.room("known", h.dtype, n, BASE)
        np.matmul(tiles(weighed), self.outer[k], out=tiles(z))
        z += self.bias[k].take(before, axis=0, mode="clip", out=known)
        if z.max() > 80:
            np.minimum(z, 80, out=z)
        return weights, weighed, z

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        out, ones = np.zeros(len(token), np.float64), np.ones(BASE, self.inner.dtype)
        for a in range(0, len(token), BATCH):
            own, (digits, before) = slice(a, a + BATCH), digits_of(token[a : a + BATCH])
            h = self.hidden(self.inputs(around[own]))
            row = np.arange(0, len(h) * BASE, BASE)
            for k in range(3):
                *_, z = self.logits(k, h, before[k])
                out[own] += z.take(row + digits[k])
                out[own] -= np.log(np.exp(z, out=z) @ ones)
        return out

    def gradients(self, around: np.ndarray, token: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """Of the sum of the negative logarithms: for embed, the gates and the later biases (rows, their gradients), and those of the other arrays. Tokens ascend."""
        x = self.inputs(around)
        h = self.hidden(x)
        dh, some, whole = self.read_off(h, token, len(token))
        dh *= 1 - h * h
        return [by_row(around.ravel(), (dh @ self.inner.T).reshape(-1, WIDTH)), *some], [crossed(x, dh), dh.sum(axis=0), *whole]

    def read_off(self, h: np.ndarray, token: np.ndarray, count: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """The gradients for the hidden units; for the gates and the later biases (rows, their gradients); for outer and the first bias. Tokens ascend; those from ``count`` on don't count."""
        n, kind = len(token), h.dtype
        digits, before = digits_of(token)
        row, ones, value = np.arange(0, n * BASE, BASE), np.ones(n, kind), np.ones(BASE, kind)
        dh = self.room("dh", kind, n, HIDDEN)
        gates, biases, outer = [], [], []
        for k in range(3):  # one after another, as a core's cache holds what one needs
            weights, weighed, z = self.logits(k, h, before[k])
            np.exp(z, out=z)
            z *= np.reciprocal(z @ value)[:, None]
            z.reshape(-1)[row + digits[k]] -= 1
            z[count:] = 0
            outer.append(crossed(weighed, z))
            b = weighed if k else dh  # in the place of what is needed no longer
            np.matmul(tiles(z), np.ascontiguousarray(self.outer[k].T), out=tiles(b))
            if k:
                weights *= b
                dh += weights
                b *= h
                first = firsts(before[k])
                rows = before[k][first]
                gates.append((rows, summed(b, first)))
                biases.append((rows, summed(z, first)))
            else:
                bias = (ones @ z)[None, :]
        return dh, [*gates, *biases], [*outer, bias]

    def run_gradients(self, spots: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """The same for all tokens of the runs ``spots``, of which the ``REACH`` at either end are only read.

        Neighbours share most of their windows, so a run's gradients of embeddings are summed by place first.
        """
        kind, (runs, length) = self.inner.dtype, spots.shape
        n = length - 2 * REACH
        around = np.stack([spots[:, d : d + n] for d in SIDES], axis=-1).reshape(runs * n, -1)
        x = self.inputs(around)
        full = self.hidden(x)
        token = spots[:, REACH:-REACH].ravel()
        at = np.argsort(token, kind="stable")
        token = token[at].astype(np.int64)
        count = int(np.searchsorted(token, EDGE))
        some_more = min(len(token), -(-count // TILE) * TILE)  # so that tiles come out even
        at = at[:some_more]
        h = full.take(at, axis=0, mode="clip", out=self.room("sorted", kind, some_more, HIDDEN))
        dh, some, whole = self.read_off(h, np.minimum(token[:some_more], VOCABULARY - 1), count)
        back = self.room("weights", kind, *full.shape)
        back[:] = 0
        put(back, at, dh)
        full *= full
        back *= np.subtract(1, full, out=full)
        dread = self.room("dread", kind, runs, length, WIDTH)
        dread[:] = 0
        each, part = self.inner.reshape(2 * REACH, 1, WIDTH, HIDDEN).swapaxes(2, 3), self.room("part", kind, 2 * REACH, runs * n, WIDTH)
        by_tile = tiles(back)
        np.matmul(by_tile, np.ascontiguousarray(each), out=part.reshape(2 * REACH, *by_tile.shape[:2], WIDTH))
        for p, d in zip(part.reshape(2 * REACH, runs, -1), SIDES):
            to = dread.reshape(runs, -1)[:, d * WIDTH : (d + n) * WIDTH]
            to += p
        embed = by_row(spots.ravel(), dread.reshape(-1, WIDTH))
        return [embed, *some], [crossed(x, back), np.ones(len(back), kind) @ back, *whole]


class Room:
    """Arrays that are used again from step to step: to get new ones from the system takes longer than most of what is done with them."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}
        self.seen: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        found = self.seen.get((name, kind, shape))
        if found is None:
            size, kept = math.prod(shape), self.kept.get(name)
            if kept is None or kept.size < size or kept.dtype != kind:
                kept = self.kept[name] = np.empty(size, kind)
                self.seen.clear()
            if len(self.seen) > 1000:
                self.seen.clear()
            found = self.seen[name, kind, shape] = kept[:size].reshape(shape)
        return found


def tiles(x: np.ndarray) -> np.ndarray:
    """Rows in runs of ``TILE``, short enough to be multiplied without being packed first; in one run, if that doesn't come out even."""
    n = len(x)
    return x.reshape(n // TILE, TILE, -1) if n and n % TILE == 0 else x[None]


def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The transpose of ``x`` times ``y``."""
    return np.matmul(tiles(x).swapaxes(1, 2), tiles(y)).sum(axis=0)


def digits_of(token: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The three digits of each token, and before each digit those that came first, as one number."""
    ab = token // BASE
    a = ab // BASE
    return [a, ab - a * BASE, token - ab * BASE], [np.zeros_like(a), a, ab]


def firsts(values: np.ndarray) -> np.ndarray:
    """Where each new value begins, in sorted values."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new.nonzero()[0]


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` to the next."""
    if not len(first):
        return values[:0].copy()
    pairs = values.view("F" if values.itemsize == 4 else "D")  # columns are added up two at a time
    return np.add.reduceat(pairs, first, axis=0).view(values.dtype)


def by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = firsts(rows)
    return rows[first].astype(np.int64), summed(values.take(order, axis=0, mode="clip"), first)


def put(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Rows into a table, each copied in one piece."""
    piece = f"V{values.shape[1] * values.itemsize}"
    to.view(piece)[rows, 0] = values.view(piece)[:, 0]


class Descent:
    """Steps by the root mean squares of the gradients so far, in place."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.embed_squares = np.zeros_like(net.embed)
        self.late, (*net.gate, net.bias[1], net.bias[2]) = together([*net.gate, *net.bias[1:]])
        self.whole, (net.inner, net.inner_bias, *net.outer, net.bias[0]) = together([net.inner, net.inner_bias, *net.outer, net.bias[0]])
        self.late_squares, self.squares = np.zeros_like(self.late), np.zeros_like(self.whole)
        self.late_gradients, self.parts = together([np.zeros_like(x) for x in (*net.gate, *net.bias[1:])])

    def step(self, spots: np.ndarray) -> None:
        ((rows, g), *some), whole = self.net.run_gradients(spots)
        self.steps += 1
        now = self.embed_squares.take(rows, axis=0, mode="clip")
        now += g * g
        put(self.embed_squares, rows, now)
        change = self.change(g, now)
        change += self.net.embed.take(rows, axis=0, mode="clip")
        put(self.net.embed, rows, change)
        # the other tables are so small that all of their rows are gone over, most of them for a zero
        g = self.late_gradients
        g[:] = 0
        for part, (rows, of) in zip(self.parts, some):
            put(part, rows, of)
        self.late_squares += g * g
        self.late += self.change(g, self.late_squares.copy())
        g = np.concatenate([x.ravel() for x in whole])
        self.squares *= 0.99
        self.squares += 0.01 * g * g
        g *= self.rate / 4
        g /= np.sqrt(self.squares / (1 - 0.99**self.steps)) + 1e-6
        self.whole -= g

    def change(self, gradients: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """In the place of ``squares``."""
        np.sqrt(squares, out=squares)
        squares += 1e-6
        np.divide(gradients, squares, out=squares)
        squares *= -2 * self.rate
        return squares


def together(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Copies of arrays in one flat one, and where each of them is there."""
    flat = np.concatenate([x.ravel() for x in arrays])
    ends = np.cumsum([x.size for x in arrays])
    return flat, [flat[b - x.size : b].reshape(x.shape) for x, b in zip(arrays, ends)]


def runs_of(tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Tokens of texts that end at ``cut``, with edges between and around the texts, in runs of ``RUN`` with those on either side."""
    if not len(tokens):
        return np.zeros((0, RUN + 2 * REACH), np.uint16)
    ends = np.unique(cut)  # texts without tokens have no edges
    at = np.arange(len(tokens)) + REACH * np.searchsorted(ends, np.arange(len(tokens)), side="right")
    size = -(-(len(tokens) + REACH * (len(ends) - 2)) // RUN) * RUN
    wide = np.full(size + 2 * REACH, EDGE, np.uint16)
    wide[at] = tokens
    return np.lib.stride_tricks.sliding_window_view(wide, RUN + 2 * REACH)[::RUN]


def windows(tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each token of texts that end at ``cut``, the tokens on either side."""
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    n, pad = np.arange(len(tokens)), np.full(REACH, EDGE, np.int32)
    wide = np.concatenate([pad, tokens.astype(np.int32), pad])
    out = np.empty((len(tokens), 2 * REACH), np.int32)
    for k, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        out[:, k] = np.where((n + d >= cut[text]) & (n + d < cut[text + 1]), wide[n + d + REACH], EDGE)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in the texts of ``docs``."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(FOLD)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held))
            distinct, which = np.unique(words, return_inverse=True)
            return distinct, np.bincount(which, weights=n).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = held[0]
            for k in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], schema=schema)
            held.clear()

        for frame in lean(frames):
            for _, _, data, edges in parts(frame.column("text")):
                held.append(np.unique(hasher(data, edges)[2], return_counts=True))
                if sum(len(w) for w, _ in held) > 2 * HELD:
                    held = [summed()]
                    if len(held[0][0]) > HELD:
                        yield from flush()
        if held:
            held = [summed()]
            yield from flush()

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) % np.uint64(classes)).astype(np.int32)


@dataclass
class Words:
    """What tasks know of words: the named ones' tokens, the classes' sums, and the costs of common words of classes."""

    names: np.ndarray  # hashes, sorted
    numbers: np.ndarray  # their tokens
    classes: np.ndarray  # how often words of each class occur
    keys: np.ndarray  # hashes, sorted
    costs: np.ndarray

    @property
    def named(self) -> int:
        """The tokens from here on are classes."""
        return VOCABULARY - len(self.classes)

    @staticmethod
    def _find(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        return at, keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at, there = self._find(self.names, hashes)
        own = class_of(hashes, len(self.classes)) + self.named
        return np.where(there, self.numbers[at], own) if len(self.names) else own

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Costs of words of classes within their class, -1 where they are not here."""
        at, there = self._find(self.keys, hashes)
        return np.where(there, self.costs[at], -1).astype(np.int64) if len(self.keys) else np.full(len(hashes), -1)

    def unseen(self, hashes: np.ndarray) -> np.ndarray:
        """Costs of words that have never been counted."""
        return np.rint(UNIT * np.log(self.classes[class_of(hashes, len(self.classes))] + 1.0)).astype(np.int64)


@dataclass
class Model:
    words: Words
    flat: np.ndarray  # the network
    rare: DataFrame  # (word, cost) of the words of classes that are not in ``words``


def vocabulary(docs: DataFrame, head: int = HEAD, n_classes: int = CLASSES) -> tuple[Words, DataFrame, np.ndarray]:
    """Words, the costs of rare ones, and how often each token occurs."""
    counted = written(word_counts(docs), "word-counts")
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY - n_classes).toArrow()
    names, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    frequencies = np.zeros(VOCABULARY)
    frequencies[: len(n)] = n
    # named are the words that come before the last of them in the order of counts, then hashes
    last = (int(n[-1]), int(names.view(np.int64)[-1])) if len(n) else (0, 0)
    rest = counted.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    rest = rest.withColumn("class", (F.shiftrightunsigned("word", 1) % n_classes).cast("int"))  # as ``class_of``
    sums = rest.groupBy("class").agg(F.sum("n").alias("total"))  # n_classes rows
    classes = np.zeros(n_classes, np.int64)
    for r in sums.collect():
        classes[r["class"]] = r["total"]
    frequencies[VOCABULARY - n_classes :] = classes
    cost = F.round(UNIT * F.log(F.col("total") / F.col("n"))).cast("long")
    costs = written(rest.join(F.broadcast(sums), "class").select("word", "n", cost.alias("cost")), "word-costs")
    common = size_class(F.col("n")) >= head_from(costs, head)
    found = costs.where(common).select("word", "cost").toArrow()
    keys, values = found.column("word").to_numpy().view(np.uint64), found.column("cost").to_numpy().astype(np.int32)
    order, by_name = np.argsort(keys), np.argsort(names)
    return Words(names[by_name], by_name.astype(np.int32), classes, keys[order], values[order]), costs.where(~common).select("word", "cost"), frequencies


def tokenised(docs: DataFrame, words: Words) -> DataFrame:
    """row, doc_id, key (a hash of the row), ids (two bytes each), cost of common words of classes, and the rare ones, of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = sent.value, WordHasher(FOLD)
        for frame in (some for frame in lean(frames) for some in slices(frame)):
            cost = np.zeros(frame.num_rows, np.int64)
            ids: list[list[bytes]] = [[] for _ in range(frame.num_rows)]
            open_: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for a, _, data, edges in parts(frame.column("text")):
                _, _, hashes, upto = hasher(data, edges)
                tokens = words.tokens(hashes)
                raw = tokens.astype("<u2").tobytes()
                for k, (x, y) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
                    ids[a + k].append(raw[2 * x : 2 * y])
                row, rare = np.repeat(np.arange(a, a + len(edges) - 1), np.diff(upto))[tokens >= words.named], hashes[tokens >= words.named]
                each = words.known(rare)
                cost += np.bincount(row, weights=np.maximum(each, 0), minlength=frame.num_rows).astype(np.int64)
                open_.append((row[each < 0], rare[each < 0]))
            row, rare = (np.concatenate(x) for x in zip(*open_))
            order = np.lexsort((rare, row))
            row, rare = row[order], rare[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])]) if len(row) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(row)])
            row, rare = row[first], rare[first]
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(frame.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(rare.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(words.unseen(rare))], names=["word", "times", "unseen"]))
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array([b"".join(x) for x in ids], pa.binary()), pa.array(cost), tail], names=["row", "doc_id", "key", "ids", "cost", "tail"])

    of = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return written(of.mapInArrow(cut, "row bigint, doc_id bigint, key bigint, ids binary, cost bigint, tail array<struct<word:bigint,times:bigint,unseen:bigint>>"), "tokens")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a column of ids, and where each text begins in them."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", "<u2")[edges[0] // 2 : edges[-1] // 2], (edges - edges[0]) // 2


def _chunks(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Of rows (shard, ids), sorted by shard: about ``CHUNK`` tokens of a shard at a time, whatever the batches, and whether they are its last."""
    now: int | None = None
    held: list[np.ndarray] = []
    size = 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(held), np.cumsum([0, *map(len, held)])

    for frame in frames:
        tokens, cut = _texts(frame.column("ids"))
        for k, shard in enumerate(frame.column("shard").to_pylist()):
            if shard != now:
                if held:
                    yield now, *taken(), True
                now, held, size = shard, [], 0
            elif size >= CHUNK:
                yield now, *taken(), False
                held, size = [], 0
            held.append(tokens[cut[k] : cut[k + 1]].copy())
            size += len(held[-1])
    if held:
        yield now, *taken(), True


def descended(found: DataFrame, flat: np.ndarray, rate: float) -> np.ndarray:
    """The average of the weights that descents from ``flat`` reach over the shards of ``found`` (shard, key, ids)."""
    sent = found.sparkSession.sparkContext.broadcast(flat)
    rows = "place int, shard bigint, weight bigint, part binary"
    schema = pa.schema([("place", pa.int32()), ("shard", pa.int64()), ("weight", pa.int64()), ("part", pa.binary())])
    size = 8192

    def descend(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, seen = None, 0
        for shard, tokens, cut, last in _chunks(frames):
            if way is None:
                way, seen = Descent(Network.unflat(sent.value), rate), 0
            runs = runs_of(tokens, cut)
            order = np.random.default_rng(len(tokens)).permutation(len(runs))
            for k in range(0, len(runs), BATCH // RUN):
                way.step(runs[order[k : k + BATCH // RUN]])
            seen += len(tokens)
            if last:
                if seen:
                    out = way.net.flat().astype("<f4")
                    for k in range(0, len(out), size):
                        yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([out[k : k + size].tobytes()], pa.binary())], schema=schema)
                way = None

    def average(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of a place pass by one after another, in order."""
        now, total, weight = None, None, 0

        def mean() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["place", "part"])

        for frame in frames:
            for place, w, part in zip(*(frame.column(k).to_pylist() for k in ("place", "weight", "part"))):
                if place != now:
                    if now is not None:
                        yield mean()
                    now, total, weight = place, 0.0, 0
                total, weight = total + w * np.frombuffer(part, "<f4").astype(np.float64), weight + w
        if now is not None:
            yield mean()

    trained = found.repartition("shard").sortWithinPartitions("shard", "key", "ids").select("shard", "ids").mapInArrow(descend, rows)
    means = trained.repartition("place").sortWithinPartitions("place", "shard").select("place", "weight", "part").mapInArrow(average, "place int, part binary").toArrow()
    return np.frombuffer(b"".join(x["part"] for x in sorted(means.to_pylist(), key=lambda x: x["place"])), "<f4") if means.num_rows else flat


def fit(found: DataFrame, frequencies: np.ndarray) -> np.ndarray:
    """The network's weights, trained on ``tokenised`` rows."""
    flat = Network.new(frequencies).flat()
    shards = max(1, round(frequencies.sum() / ROUNDS / SHARD))
    key = F.col("key")
    for r in range(PASSES * ROUNDS):
        # each pass deals the rounds and shards anew
        dealt = found.where(F.pmod(F.xxhash64(key, F.lit(r // ROUNDS)), F.lit(ROUNDS)) == r % ROUNDS).select(F.pmod(F.xxhash64(key, F.lit(-1 - r // ROUNDS)), F.lit(shards)).cast("long").alias("shard"), "key", "ids")
        flat = descended(dealt, flat, RATE / np.sqrt(1 + r))
    return flat


def train(docs: DataFrame, head: int = HEAD, n_classes: int = CLASSES) -> Model:
    """Fit on all texts of ``docs`` (doc_id, text)."""
    words, rare, frequencies = vocabulary(docs, head, n_classes)
    return Model(words, fit(tokenised(docs, words), frequencies), rare)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens and pll of ``tokenised`` rows."""
    sent = found.sparkSession.sparkContext.broadcast(model.flat)
    rest = found.select("row", F.explode("tail").alias("_")).select("row", "_.*")
    more = rest.join(model.rare, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("cost", "unseen")).alias("more"))

    def scores(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unflat(sent.value)
        for frame in frames:
            tokens, cut = _texts(frame.column("ids"))
            sums = np.zeros(frame.num_rows, np.int64)
            for a in range(0, len(tokens), CHUNK):
                b = min(a + CHUNK, len(tokens))
                # with the tokens around the chunk, in their own texts
                x, y = max(0, a - REACH), min(len(tokens), b + REACH)
                around = windows(tokens[x:y], np.clip(cut, x, y) - x)[a - x : b - x]
                cost = np.rint(-UNIT * net.log_probabilities(around, tokens[a:b].astype(np.int64)))
                text = np.searchsorted(cut, np.arange(a, b), side="right") - 1
                sums += np.bincount(text, weights=cost, minlength=frame.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(np.diff(cut)), pa.array(sums)], names=["row", "doc_id", "cost", "n_tokens", "net"])

    out = found.select("row", "doc_id", "cost", "ids").mapInArrow(scores, "row bigint, doc_id bigint, cost bigint, n_tokens bigint, net bigint")
    whole = F.col("net") + F.col("cost") + F.coalesce("more", F.lit(0))
    return out.join(more, "row", "left").select("doc_id", "n_tokens", (-whole / UNIT).alias("pll"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens and pll, the sum of the words' log-probabilities, for each row of ``docs`` (doc_id, text)."""
    return scored(tokenised(docs, model.words), model)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words, rare, frequencies = vocabulary(docs)
    found = tokenised(docs, words)
    out = scored(found, Model(words, fit(found, frequencies), rare))
    return out.select("doc_id", "n_tokens", F.round("pll", 3).alias("pll"), F.round(F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")), 5).alias("mean_pll"))
