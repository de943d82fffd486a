"""Operator 1, secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule is a regular expression. From its syntax tree follows a Boolean query: clauses, one of which must hold all
its trigrams of the case-folded text for the rule to match there. The index holds postings (trigram, doc_id); a
clause's postings are intersected by counting its trigrams in each document, and only (document, rule) pairs that
come through are verified by the expression itself. A rule from which no trigram follows scans every text.

The index is made for the trigrams that the rules' queries name: no other list would ever be read. At most one row
a document and named trigram leaves the scan.

Matches are leftmost and do not overlap, by kind; positions are code points, end exclusive. ``regexp_extract_all``
gives what lies before each match and the match itself, so positions are running sums of lengths.

Null and empty texts have no spans, but a row. Repeated rows and rows without doc_id keep one row each: the postings
of one doc_id are taken together, which may only add candidates. Spans that begin at one place go by their kind's place
in the list. A very long text is one value of its row, as everywhere in Spark SQL; its matches are one array. Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
import zlib
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, written


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java regular expression without capturing groups but one, the value, if ``least`` is of it."""

    kind: str
    pattern: str
    least: int  # code points that the value, or else the match, needs; shorter matches are dropped
    value: bool = False
    quick: str = ""  # finds whether there is a match of the least length, for rules without trigrams


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, value=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, quick=r"[0-9a-f]{32}"),
)
#: Kinds beyond the base ones: private key headers, and tokens whose issuers mark them by a prefix.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 1),
    Rule("git_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 20, value=True),
)

#: Candidates are broadcast to the texts while they take no more than this, at 128 bytes each in a hash table of the JVM.
BROADCAST_BYTES, CANDIDATE_BYTES = 64 << 20, 128
#: Strings that a part of an expression may stand for are listed up to so many; beyond, it counts as unknown.
_EXACT = 24


def _strings(tree) -> tuple[set[str] | None, list[frozenset[str]]]:
    """Of a syntax tree: its strings, case folded, if they are few (else None), and clauses of trigrams."""
    exact = {""}
    clauses: list[frozenset[str]] = [frozenset()]

    def grams(words: set[str]) -> list[frozenset[str]]:
        return [frozenset(w[k : k + 3] for k in range(len(w) - 2)) for w in words]

    def close() -> None:
        """The strings gathered so far end here; what they need joins the clauses."""
        nonlocal exact, clauses
        clauses = [a | b for a, b in product(clauses, grams(exact))]
        exact = {""}

    for op, arg in tree:
        part: set[str] | None = None
        inner: list[frozenset[str]] = [frozenset()]
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, inner = _strings(arg[-1])
        elif op is sre.BRANCH:
            found = [_strings(x) for x in arg[1]]
            part = None if any(p is None for p, _ in found) else set().union(*(p for p, _ in found))
            inner = [c for _, cs in found for c in cs]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            p, cs = _strings(body)
            if low == high == 1 or (p is not None and low == high and len(p) == 1):
                part = None if p is None else {x * low for x in p}
            elif p is not None and (low, high) == (0, 1):
                part = p | {""}
            if low:
                inner = cs
        if part is not None and len(part) * len(exact) <= _EXACT:
            exact = {a + b for a, b in product(exact, part)}
        else:
            close()
            clauses = [a | b for a, b in product(clauses, inner)]
    whole = exact if clauses == [frozenset()] and len(tree) and _closed(tree) else None
    if whole is None:
        close()
        return None, clauses
    return whole, grams(whole)


def _closed(tree) -> bool:
    """Whether the tree stands for literal strings alone."""
    for op, arg in tree:
        if op is sre.LITERAL or (op is sre.IN and all(o is sre.LITERAL for o, _ in arg)):
            continue
        if op is sre.SUBPATTERN and _closed(arg[-1]):
            continue
        if op is sre.BRANCH and all(_closed(x) for x in arg[1]):
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 1 and _closed(arg[2]):
            continue
        return False
    return True


def trigram_query(pattern: str, most: int = 4) -> list[frozenset[str]]:
    """Clauses of trigrams of the case-folded text, one of which every match fulfils; none: no trigram is mandatory.

    A clause keeps ``most`` trigrams, picked alike in every clause: fewer only let more candidates through.
    """
    implied = lambda cs: {c for c in cs if not any(d < c for d in cs)}
    _, clauses = _strings(parser.parse(pattern))
    clauses = implied({frozenset(sorted(c, key=lambda t: zlib.crc32(t.encode()))[:most]) for c in implied(set(clauses))})
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, over the case-folded texts."""
    folded = docs.select("doc_id", F.lower("text").alias("_text"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_text"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the indexed rules, by place, one of whose clauses has all its postings in the document."""
    clauses = [(k, j, t, len(c)) for k, r in enumerate(rules) for j, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    asked = postings.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, n bigint")
    # as many rows as the rules' queries have trigrams
    met = postings.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "clause", "n").agg(F.count_distinct("trigram").alias("held"))
    return met.where("held = n").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, kind, end) of the rule's matches."""
    group = "(" + (rule.pattern if not rule.value else rule.pattern.replace("([", "(?:[", 1)) + ")"
    walk = F.lit(r"\G(?s)(.*?)" + group)  # each match starts where the last one ended
    before = F.transform(F.regexp_extract_all(text, walk, F.lit(1)), F.length)
    found = F.transform(F.regexp_extract_all(text, walk, F.lit(2)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1)), F.length) if rule.value else found
    each = F.arrays_zip(before.alias("gap"), found.alias("len"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)").alias("out"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.array_append(held["out"], span)).otherwise(held["out"]).alias("out"))

    return F.aggregate(each, empty, step, lambda held: held["out"])


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and found, the sorted array of (start, kind, end) of all matches, for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for c in q for t in c})
    asked = candidates(build_index(docs, trigrams), rules).select(F.col("doc_id").alias("_id"), "rules")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    full = [k for k, q in enumerate(queries) if not q]
    # rules without trigrams scan each text where it is read; only texts that some rule may match go on to be verified
    mark = F.array_compact(F.array(*[F.when(F.col("text").rlike(rules[k].quick or rules[k].pattern), F.lit(k)) for k in full])) if full else F.expr("cast(array() as array<int>)")
    asked = written(asked, "secret-candidates")
    if asked.count() * CANDIDATE_BYTES <= BROADCAST_BYTES:  # else texts are shuffled to their candidates
        asked = F.broadcast(asked)
    marked = docs.withColumn("_full", mark)
    wanted = marked.join(asked, marked.doc_id.eqNullSafe(F.col("_id")), "left")
    todo = F.array_union(F.col("_full"), F.coalesce("rules", F.expr("cast(array() as array<int>)")))
    found = F.array_sort(F.flatten(F.array(*[F.when(F.array_contains(F.col("_todo"), k), _spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)])))
    return wanted.select("doc_id", "text", todo.alias("_todo")).select("doc_id", F.when(F.size("_todo") > 0, found).otherwise(none).alias("found"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE + MORE
    found = scan(table(spark, sf_dir, "documents"), rules)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("found"), rules).alias("spans"))
