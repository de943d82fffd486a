from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import alignment
from quillspark.llm.alignment import Pair

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return Pair(*map(str, FILES))


def groups_of(pair, text):
    """Whole text by both tokenizers, one character of either at a time."""
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[k] for k in a) != raw or b"".join(pair.b_bytes[k] for k in b) != raw:
        return None
    out, mine, theirs, i, j = [], [], [], 0, 0
    a, b = a[::-1], b[::-1]
    while a or b:
        if i <= j:
            mine.append(a.pop())
            i += len(pair.a_bytes[mine[-1]])
        else:
            theirs.append(b.pop())
            j += len(pair.b_bytes[theirs[-1]])
        if i == j:
            out.append((mine, theirs))
            mine, theirs = [], []
    return out


def by_hand(pair, docs):
    every = [groups_of(pair, t) if t else None for _, t in docs]
    count = Counter((g[0][-1], g[1][-1]) for doc in every for g in doc or [])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for (doc_id, _), doc in zip(docs, every):
        links = [(g[0][-1], g[1][-1]) for g in doc or []]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in doc or [])
        rows.append((doc_id, sum(len(g[0]) for g in doc or []), sum(len(g[1]) for g in doc or []), len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if doc else ""))
    return sorted(rows, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", *NUMBERS).collect()), key=str)


ODD = ["x", " ", "  two  spaces ", "\n\nlines\n\n", "a\r\n;\r\nb", "tab\tand\x0bmore\x0c", "  x　 y   z", "<|endoftext|> <s> </s> <unk>", "été naïve 你好 \U0001f600 \U0001f600", "it's we'll 'tis", "a ▁ b", "▁", "\x00 null", "12 345 6789", "end ", "﻿ bom", "word" * 50, "İ ı ß", "(){};\r", "  ", "\n", "a\u0085 b", " lead"]


def test_whole_texts_against_both_tokenizers(spark, pair, edge_docs):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, None), (5, ""), (7, ODD[2])] + [(r.doc_id, r.text) for r in edge_docs.collect() if len(r.text or "") < 10_000]
    want = by_hand(pair, docs)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    assert rows(alignment.align(frame)) == want
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[5] < r[4] for r in want) > 5


def test_nothing_common_and_pairs_by_join(spark, pair):
    docs = [(k, t * 3) for k, t in enumerate(ODD)] + [(50 + k, "the same words again and again, the same") for k in range(5)]
    frame = spark.createDataFrame(docs, DOCS)
    assert rows(alignment.align(frame, head=0, most_pairs=0)) == rows(alignment.align(frame)) == by_hand(pair, docs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,;'(\r\n\t  　é你\U0001f600 \u0085{}*/0"), min_size=1, max_size=30), min_size=1, max_size=4))
def test_cut_texts_have_the_tokens_of_whole_ones(texts):
    pair = alignment.pair_of(tuple(map(str, FILES)))
    for _, _, data, edges in pair.chunks(pa.array(texts)):
        begins, _, upto = pair.segments(data, edges)
        ends = np.r_[begins[1:], len(data)]
        for k, text in enumerate(texts):
            segments = [data[begins[x] : ends[x]].tobytes() for x in range(upto[k], upto[k + 1])]
            assert b"".join(segments) == (" " + text).encode()
            assert sum((pair.a.encode(s.decode(), add_special_tokens=False).ids for s in segments), []) == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert sum((pair.b.encode("\n" + s.decode())[2:] for s in segments), []) == pair.b.encode(text)


def test_where_texts_are_cut(pair):
    cut = lambda s: [x.tobytes().decode() for x in np.split(np.frombuffer(s.encode(), np.uint8), pair.cuts(np.frombuffer(s.encode(), np.uint8)))]
    assert cut(" one two\n three") == [" one", " two", "\n three"]
    assert cut("a;\r\nb") == ["a;\r\nb"]  # B has an entry of ; and \r, and \n follows white space
    assert cut("é 你 \U0001f600 z") == ["é", " 你", " \U0001f600", " z"]
    assert cut("a　 b  c  d") == ["a　 b  c  d"]


def test_long_texts_in_pieces(spark, pair, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    text = " ".join(f"word{k % 701} and\nété{k % 13}" for k in range(60_000)) + "x" * 3_000_000
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": ["short one", text, "after it"]}), f"{tmp_path}/d.parquet")
    frame = spark.read.parquet(f"{tmp_path}/d.parquet")
    want = rows(alignment.align(frame))
    assert [r[0] for r in want] == [1, 2, 3]
    whole = pair.a.encode(" " + text, add_special_tokens=False).ids
    assert want[1][1:3] == (len(whole), len(pair.b.encode(text)))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Pair(str(public_tokenizers.path("word_bpe_49k.json")), str(FILES[1]))


def test_no_documents(spark, no_docs):
    assert alignment.align(no_docs).count() == 0
