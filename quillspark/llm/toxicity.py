"""Operator 13, toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around a hit.

The lexicon is learned: words, and beginnings of words, that labelled toxic documents hold far more often than others.
Its entries, with fixed lists of words that report or address, make one trie. A state of the automaton is the set of
(trie node, edits so far) that a word may have reached, that is, the product of the trie with every entry's Levenshtein
automaton, made deterministic as words ask for it. All words of a piece of text step through it at once, a letter at a
time, by numpy; those no entry can accept any more are dropped, mostly after two or three letters. So ``idiiot`` and
``stup1d`` are found as well as the words themselves, at one edit from five letters on, at two from nine.

A hit is *quoted* if within ``WINDOW`` words an opening quotation mark comes before it and a closing one after it, or a
word that reports (said, wrote, term, ...) comes before it; else it is *abuse*. It is *aimed* if a word that addresses
(you, ...) is in its window. A document's features are the summed weights of its distinct hits, quoted and
abuse apart, their number and density, aimed hits and its length; a logistic regression makes them a probability. Its
prior says that quoted hits count little, which the labels may overrule.

Weights are logarithms of how much more often toxic documents have a hit. In fitting, a document's own counts are taken
off its hits' counts first; else rare words would look better on the documents that brought them in. Hits by edits have
weights of their own, near seven tenths of the entry's own until the labels say otherwise.

Fitting reads a bounded sample, the ``max_labelled`` labelled documents of the least seeded hash; all that leaves Spark
for the driver is the lexicon (``max_terms`` at most) and some hits a document. Scoring is one pass over all texts, in
pieces of some MB with a window's overlap, however long a text is.

Null and empty texts have no hits: they get the score of an empty document. Labels that are null, or of unknown
documents, are passed over; of several labels of a document the highest counts. Repeated rows keep one row each and
count once in the fit. Without labels of both kinds every score is the share of toxic labels (0 if there are none).
A null doc_id is not held out and never fitted on. An empty table gives no rows. Other columns are not read. Ties of
lexicon entries at a hit go to fewer edits, then the longer, then the earlier one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import lean, parts, table, written

MAX_LABELLED, MAX_TERMS = 12_000, 600
WINDOW = 8
#: Edits allowed from so many letters on, of whole words and of beginnings.
EDITS = {"word": ((9, 2), (5, 1)), "stem": ((9, 1),)}
#: Least toxic documents of an entry, and least ratio of its rates.
LEAST_DOCS, LEAST_RATIO = 3, 4.0
THRESHOLD = 0.3
ABUSE, REPORT, ADDRESS = 0, 1, 2
REPORTING = "said says say wrote writes called calls quote quoted quotes word words term terms phrase sagte schrieb nannte wort zitat dit écrit mot terme citation dijo escribió palabra término cita".split()
ADDRESSING = "you your you're youre u ur du dich dir dein tu toi te vous votre tú usted ustedes vos ihr euch".split()

# letters in lower case where that is one letter, and what is a letter or digit, up to U+FFFF; all beyond is taken for letters
_LOW = np.array([ord(c.lower()) if len(c.lower()) == 1 else k for k, c in ((k, chr(k)) for k in range(0x10000))], np.uint32)
_CORE = np.array([chr(k).isalnum() for k in range(0x10000)] + [True])
_BLANK = np.zeros(0x10001, bool)
_BLANK[[k for k in range(0x10000) if chr(k).isspace()]] = True
_QUOTE = np.zeros(0x10001, bool)
_QUOTE[[ord(c) for c in "\"“”„«»‘’'‹›"]] = True


def edits_for(n: int, kind: str) -> int:
    return next((k for least, k in EDITS[kind] if n >= least), 0)


class Automaton:
    """All words within each entry's edits, as a deterministic automaton that grows as it is used.

    ``entries`` are (letters, whether any ending may follow, edits). State 0 accepts nothing and is never left.
    """

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.entries = entries
        self.symbols = np.array(sorted({ord(c) for e, _, _ in entries for c in e}), np.uint32)
        symbol = {int(c): k + 1 for k, c in enumerate(self.symbols)}  # 0: any other letter
        self.next: list[dict[int, int]] = [{}]  # the trie
        self.reach = [0]  # most edits of any entry below a node
        self.ends: list[list[int]] = [[]]
        for k, (letters, _, edits) in enumerate(entries):
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in letters:
                node = self.next[node].setdefault(symbol[ord(c)], len(self.next))
                if node == len(self.reach):
                    self.next.append({})
                    self.reach.append(0)
                    self.ends.append([])
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append(k)
        self.known: dict[tuple, int] = {((), None): 0}
        self.sets: list[tuple] = [((), None)]
        self.moves = np.full((64, len(self.symbols) + 1), -1, np.int32)
        self.moves[0] = 0
        self.term, self.edits = np.full(64, -1, np.int32), np.zeros(64, np.int32)
        self.start = self._state(self._closed({0: 0}), None)

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """Nodes with fewest edits, those that leaving out letters of entries reaches too."""
        todo = list(at)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                e = at[node] + 1
                if e <= self.reach[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        return at

    def _better(self, a: tuple | None, b: tuple) -> tuple:
        return b if a is None or b < a else a

    def _state(self, at: dict[int, int], begun: tuple | None) -> int:
        """The number of a set of nodes and of the best beginning passed so far, (edits, -letters, entry)."""
        for node, e in at.items():
            for k in self.ends[node]:
                letters, open_, most = self.entries[k]
                if open_ and e <= most:
                    begun = self._better(begun, (e, -len(letters), k))
        key = tuple(sorted(at.items())), begun
        if key in self.known:
            return self.known[key]
        k = self.known[key] = len(self.sets)
        self.sets.append(key)
        if k >= len(self.moves):
            grow = lambda x, fill: np.concatenate([x, np.full_like(x, fill)])
            self.moves, self.term, self.edits = grow(self.moves, -1), grow(self.term, -1), grow(self.edits, 0)
        best = begun
        for node, e in at.items():
            for j in self.ends[node]:
                if e <= self.entries[j][2]:
                    best = self._better(best, (e, -len(self.entries[j][0]), j))
        if best is not None:
            self.term[k], self.edits[k] = best[2], best[0]
        return k

    def _move(self, state: int, symbol: int) -> int:
        at, begun = self.sets[state]
        to: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and e < to.get(node, 99):
                to[node] = e

        for node, e in at:
            put(node, e + 1)  # a letter too many
            for s, child in self.next[node].items():
                put(child, e + (s != symbol))
        to = self._closed(to)
        return self._state(to, begun) if to or begun else 0

    def run(self, letters: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words ``letters[begins:ends]``: which of them an entry accepts, which entry, with how many edits."""
        if not self.entries:
            none = np.zeros(0, np.int64)
            return none, none, none
        out, which, at = np.zeros(len(begins), np.int32), np.arange(len(begins)), begins.copy()
        state = np.full(len(begins), self.start, np.int32)
        while len(which):
            done = at >= ends[which]
            if done.any():
                out[which[done]] = state[done]
                which, at, state = which[~done], at[~done], state[~done]
            c = letters[at]
            k = np.minimum(np.searchsorted(self.symbols, c), len(self.symbols) - 1)
            symbol = np.where(self.symbols[k] == c, k + 1, 0)
            new = self.moves[state, symbol]
            if (open_ := np.flatnonzero(new < 0)).size:
                for s, x in {*zip(state[open_].tolist(), symbol[open_].tolist())}:
                    to = self._move(s, x)  # may let the table grow
                    self.moves[s, x] = to
                new = self.moves[state, symbol]
            live = new != 0
            # where only a beginning is left, no letter changes anything
            which, at, state = which[live], at[live] + 1, new[live]
        found = np.flatnonzero(self.term[out] >= 0)
        return found, self.term[out[found]], self.edits[out[found]]


@dataclass
class Lexicon:
    """``terms``: (letters, whether a beginning). The words that report or address follow them in the automaton."""

    terms: list[tuple[str, bool]]
    _automaton: Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> list:
        return self.terms

    def __setstate__(self, terms: list) -> None:
        self.terms, self._automaton = terms, None

    def automaton(self) -> Automaton:
        if self._automaton is None:
            have = {x for x, open_ in self.terms if not open_}
            around = [(w, False, 0) for w in [*REPORTING, *ADDRESSING] if w not in have]
            self._automaton = Automaton([(x, open_, edits_for(len(x), "stem" if open_ else "word")) for x, open_ in self.terms] + around)
            kinds = {w: REPORT for w in REPORTING} | {w: ADDRESS for w in ADDRESSING}
            self._automaton.kinds = np.array([ABUSE] * len(self.terms) + [kinds[w] for w, _, _ in around])
        return self._automaton


def tokens(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts that lie in ``data`` from edge to edge, as (letters, begins, ends, opens, closes, edges in words).

    A word is what lies between the first and the last letter or digit between blanks; ``opens`` and ``closes`` tell of a
    quotation mark before the first and behind the last. Letters are code points in lower case.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(code) != len(data) else None
    edges = edges if heads is None else heads[edges]
    low = np.minimum(code, 0x10000)
    black = ~_BLANK[low]
    begin, end = black.copy(), black.copy()
    begin[1:] &= ~black[:-1]
    end[:-1] &= ~black[1:]
    inner = edges[(edges > 0) & (edges < len(code))]
    begin[inner] |= black[inner]
    end[inner - 1] |= black[inner - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    core = np.flatnonzero(_CORE[low] & black)
    i, j = np.searchsorted(core, begins), np.searchsorted(core, ends)
    has = i < j
    begins, ends, i, j = begins[has], ends[has], i[has], j[has]
    first, last = (core[i], core[j - 1] + 1) if len(core) else (begins, ends)
    marks = np.r_[0, np.cumsum(_QUOTE[low])]
    letters = np.where(code < 0x10000, _LOW[np.minimum(code, 0xFFFF)], code)
    return letters, first, last, marks[first] > marks[begins], marks[ends] > marks[last], np.searchsorted(first, edges)


def near(flags: np.ndarray, before: int, after: int) -> np.ndarray:
    """For each place, whether a flag is set from ``before`` places before to ``after`` behind, itself included."""
    upto = np.r_[0, np.cumsum(flags)]
    at = np.arange(len(flags))
    return upto[np.minimum(at + after + 1, len(flags))] > upto[np.maximum(at - before, 0)]


def inside(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """For each place, whether a quotation that opened up to ``WINDOW`` places before closes up to as many behind."""
    at, far = np.arange(len(opens)), len(opens) + 2 * WINDOW
    opened = np.maximum.accumulate(np.where(opens, at, -far))
    closed = np.r_[-far, np.maximum.accumulate(np.where(closes, at, -far))[:-1]]
    closing = np.minimum.accumulate(np.where(closes, at, far)[::-1])[::-1]
    opening = np.r_[np.minimum.accumulate(np.where(opens, at, far)[::-1])[::-1][1:], far]
    return (opened > closed) & (at - opened <= WINDOW) & (closing < opening) & (closing - at <= WINDOW)


def hits(lexicon: Lexicon, letters: np.ndarray, begins: np.ndarray, ends: np.ndarray, opens: np.ndarray, closes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hits in words of texts, which ``edges`` divides: place, text, term, whether by edits, quoted, aimed. Windows end with their text."""
    auto = lexicon.automaton()
    found, term, edits = auto.run(letters, begins, ends)
    kind = auto.kinds[term] if len(found) else np.zeros(0, np.int64)
    abuse = kind == ABUSE
    at, term, edits = found[abuse], term[abuse], edits[abuse]
    text = np.searchsorted(edges, at, side="right") - 1
    if not len(at):
        return at, text, term, edits > 0, abuse[:0], abuse[:0]
    # words at places, with a window's gap between texts
    gap = 2 * WINDOW + 1
    place = np.arange(len(begins)) + gap * np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    flags = np.zeros((4, len(begins) + gap * len(edges)), bool)
    flags[0, place[found[kind == REPORT]]] = True
    flags[1, place[found[kind == ADDRESS]]] = True
    flags[2, place], flags[3, place] = opens, closes
    quoted = inside(flags[2], flags[3]) | near(flags[0], WINDOW, 0)
    return at, text, term, edits > 0, quoted[place[at]], near(flags[1], WINDOW, WINDOW)[place[at]]


class Reader:
    """Goes over a column of texts and gives each text's number of words and counted hits."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def read(self, column: pa.Array) -> tuple[np.ndarray, list[Counter]]:
        """Words of each text, and of each the number of hits by (term, by edits, quoted, aimed)."""
        n, counts = np.zeros(len(column), np.int64), [Counter() for _ in range(len(column))]
        held: tuple[int, tuple, int] | None = None  # a text that may go on: its last words, and the first of them that isn't counted yet
        for row, stop, data, edges in parts(column):
            words = tokens(data, edges)
            if held is not None and (stop - row > 1 or held[0] != row):
                self._count(counts, held[0], held[1], held[2])
                held = None
            n[row:stop] += np.diff(words[5])
            if stop - row > 1:
                self._count(counts, row, words)
                continue
            first = 0
            if held is not None:
                words, first = _joined(held[1], words), held[2]
            upto = max(first, len(words[1]) - WINDOW)  # what comes behind is known of these
            self._count(counts, row, words, first, upto)
            keep = max(0, upto - WINDOW)
            held = row, _tail(words, keep), upto - keep
        if held is not None:
            self._count(counts, held[0], held[1], held[2])
        return n, counts

    def _count(self, counts: list[Counter], row: int, words: tuple, first: int = 0, upto: int | None = None) -> None:
        at, text, *found = hits(self.lexicon, *words)
        chosen = np.flatnonzero((at >= first) & (at < (len(words[1]) if upto is None else upto)))
        for k, *key in zip(text[chosen].tolist(), *(x[chosen].tolist() for x in found)):
            counts[row + k][tuple(key)] += 1


def _tail(words: tuple, keep: int) -> tuple:
    letters, begins, ends, opens, closes, _ = words
    first = int(begins[keep]) if keep < len(begins) else len(letters)
    return letters[first:].copy(), begins[keep:] - first, ends[keep:] - first, opens[keep:], closes[keep:], np.array([0, len(begins) - keep])


def _joined(old: tuple, new: tuple) -> tuple:
    shift = len(old[0])
    return np.concatenate([old[0], new[0]]), np.r_[old[1], new[1] + shift], np.r_[old[2], new[2] + shift], np.r_[old[3], new[3]], np.r_[old[4], new[4]], np.array([0, len(old[1]) + len(new[1])])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> DataFrame:
    """(doc_id, text, toxic): the labelled documents of the least seeded hash that aren't held out, each once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_labelled rows
    return written(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-labelled")


def _terms(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, pos, neg): documents of each kind that hold a word, or a word that begins so, summed over a batch."""
    for frame in lean(frames):
        counts: Counter = Counter()
        for toxic, text in zip(frame.column("toxic").to_pylist(), frame.column("text")):
            words = set()
            for _, _, data, edges in parts(pa.array([text.as_py()])):
                letters, begins, ends, *_ = tokens(data, edges)
                raw = letters.astype("<u4").tobytes()
                words |= {raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist()) if 3 <= b - a <= 30}
            low = [w.decode("utf-32-le", "replace") for w in words]
            counts.update((w, False, toxic) for w in low)
            counts.update((w, True, toxic) for w in {w[:k] for w in low for k in range(4, len(w))})
        both = sorted({k[:2] for k in counts})
        if both:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in both]), pa.array([s for _, s in both]), pa.array([counts[w, s, 1] for w, s in both], pa.int64()), pa.array([counts[w, s, 0] for w, s in both], pa.int64())], names=["term", "stem", "pos", "neg"])


def mined(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int = MAX_TERMS) -> Lexicon:
    """Entries that toxic documents hold most tellingly.

    Of beginnings that say no more than a longer one or a word, only the longer one stays; a word explained by a
    beginning stays only if it is more telling by itself.
    """
    rate = lambda pos, neg: ((pos + F.lit(0.5)) / (n_toxic + 1)) / ((neg + F.lit(0.5)) / (n_clean + 1))
    counted = sample.mapInArrow(_terms, "term string, stem boolean, pos bigint, neg bigint").groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    telling = counted.where((F.col("pos") >= LEAST_DOCS) & (rate(F.col("pos"), F.col("neg")) >= LEAST_RATIO)).withColumn("gain", F.col("pos") * F.log(rate(F.col("pos"), F.col("neg"))))
    rows = telling.orderBy(F.desc("gain"), F.desc(F.char_length("term")), "stem", "term").limit(8 * max_terms).collect()
    taken: dict[tuple[str, bool], int] = {}
    for r in rows:
        if len(taken) == max_terms:
            break
        if r.stem and any(t.startswith(r.term) and pos >= 0.8 * r.pos for (t, _), pos in taken.items()):
            continue
        if r.stem and any(open_ and r.term.startswith(t) and len(r.term) - len(t) < 3 for (t, open_), pos in taken.items()):
            continue
        taken[r.term, r.stem] = r.pos
    return Lexicon(sorted(taken))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # a row a term: exact, by edits
    slopes: np.ndarray  # of FEATURES; the last is the constant
    share: float  # of toxic labels; the score where nothing could be learned

    def score(self, n: np.ndarray, counts: list[Counter]) -> np.ndarray:
        if not len(self.slopes):
            return np.full(len(n), self.share)
        x = np.array([features(k, c, self.weights) for k, c in zip(n.tolist(), counts)]).reshape(len(n), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes, -40, 40)))


#: Summed weights of distinct abuse, of distinct quoted hits, of the strongest, density of abuse, aimed, length, constant; and what they weigh before any label is seen.
FEATURES, PRIOR = 7, np.array([1.0, 0.1, 0.5, 0.5, 0.3, -0.2, -4.0])


def features(n: int, counts: Counter, weights: np.ndarray) -> list[float]:
    plain: dict[tuple[int, bool], int] = {}
    quoted: set[tuple[int, bool]] = set()
    aimed = 0
    for (term, edited, quote, aim), k in counts.items():
        if quote:
            quoted.add((term, edited))
        else:
            plain[term, edited] = plain.get((term, edited), 0) + k
            aimed += k * aim
    of = {t: float(weights[t[0], int(t[1])]) for t in {*plain, *quoted}}
    every = sum(of[t] * k for t, k in plain.items())
    return [min(sum(of[t] for t in plain), 40.0) / 4, min(sum(of[t] for t in quoted if t not in plain), 40.0) / 4, max([0.0, *(of[t] for t in plain)]) / 4, min(every / math.sqrt(n + 1), 8.0), math.log1p(min(aimed, 50)), math.log1p(n) / 4, 1.0]


def term_weights(pos: np.ndarray, neg: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Weights from documents of each kind that have a term exactly (column 0) and by edits (column 1)."""
    exact = np.log(((pos[:, 0] + 0.5) / (n_toxic + 1)) / ((neg[:, 0] + 0.5) / (n_clean + 1)))
    exact = np.maximum(exact, 0)
    prior = 0.5 * np.exp(0.7 * exact) * (n_toxic + 1) / (n_clean + 1)
    edited = np.log(((pos[:, 1] + prior) / (n_toxic + 1)) / ((neg[:, 1] + 0.5) / (n_clean + 1)))
    return np.stack([exact, np.maximum(edited, 0)], axis=1)


def regress(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's steps, drawn to ``prior``."""
    hold = np.full(x.shape[1], 0.5)
    hold[-1] = 0.01
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + hold * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    sample = labelled(docs, labels, max_labelled)
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = kinds.get(1, 0), sum(k for t, k in kinds.items() if t != 1)
    if not n_toxic or not n_clean:
        return Model(Lexicon([]), np.zeros((0, 2)), np.zeros(0), 1.0 if n_toxic else 0.0)
    lexicon = mined(sample, n_toxic, n_clean, max_terms)

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for frame in lean(frames):
            n, counts = reader.read(frame.column("text"))
            flat = [[[*map(int, key), k] for key, k in c.items()] for c in counts]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("toxic"), pa.array(n), pa.array(flat, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "toxic", "n", "hits"])

    # a row a labelled document, of at most eight numbers for each term
    rows = sample.mapInArrow(counted, "doc_id bigint, toxic int, n bigint, hits array<array<bigint>>").orderBy("doc_id").collect()
    pos, neg = np.zeros((len(lexicon.terms), 2)), np.zeros((len(lexicon.terms), 2))
    for r in rows:
        for t, e in {(t, e) for t, e, *_ in r.hits}:
            (pos if r.toxic == 1 else neg)[t, e] += 1
    whole = term_weights(pos, neg, n_toxic, n_clean)
    # what the weights are without a toxic, or a clean, document that has the term
    less = {1: term_weights(np.maximum(pos - 1, 0), neg, n_toxic - 1, n_clean), 0: term_weights(pos, np.maximum(neg - 1, 0), n_toxic, n_clean - 1)}
    y = np.array([r.toxic == 1 for r in rows], float)
    x = np.array([features(r.n, Counter({(t, bool(e), bool(q), bool(a)): k for t, e, q, a, k in r.hits}), less[int(r.toxic == 1)]) for r in rows])
    return Model(lexicon, whole, regress(x, y), n_toxic / (n_toxic + n_clean))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits, n_quoted) of every row of ``docs``: hits in all, and those that are quoted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_terms words and their weights

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value.lexicon)
        for frame in lean(frames):
            n, counts = reader.read(frame.column("text"))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(sent.value.score(n, counts), pa.float64()), pa.array([sum(c.values()) for c in counts], pa.int64()), pa.array([sum(k for key, k in c.items() if key[2]) for c in counts], pa.int64())], names=["doc_id", "score", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id bigint, score double, n_hits bigint, n_quoted bigint")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_quoted")
