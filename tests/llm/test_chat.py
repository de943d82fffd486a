from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat
from quillspark.llm.chat import BODY, END, TURN, escape, read_string, unescape

PIECES = st.lists(st.sampled_from([TURN, BODY, END, "\\", "### ", "<|endoftext|>", "a", "é\U0001f600", "\n", "<", ">", "#"]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text
    for mark in (TURN, BODY, END):
        assert all(escape(text)[:k].endswith("\\") for k in range(len(escape(text))) if escape(text).startswith(mark, k))


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
@settings(max_examples=200, deadline=None)
def test_string_is_read_back(turns):
    assert read_string("".join(f"{TURN}{escape(r)}{BODY}{escape(t)}{END}" for r, t in turns)) == turns


def want(rows: list[tuple]) -> dict:
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("folder", ["edge", "/root/testdata/sf0.001"])
def test_op3(spark, sf, folder):
    d = sf if folder == "edge" else folder
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op3(spark, d).collect()}
    assert got == want(rows)


def test_ids_and_masks(spark):
    rows = [(1, 0, "user", "hello </turn>"), (1, 1, "assistant", "yes <turn>"), (1, 2, "assistant", "")]
    found = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    turn, body, end = chat.reserved(chat.default_tokenizer())
    assert [[r["ids"].count(x) for x in (turn, body, end)] for r in found] == [[1, 1, 1]] * 3
    said = len(chat._tokenizer(chat.default_tokenizer()).encode(escape("yes <turn>"), add_special_tokens=False).ids)
    assert [sum(r["loss_mask"]) for r in found] == [0, said, 0]
    assert all(len(r["ids"]) == len(r["loss_mask"]) and all(i < turn for i, m in zip(r["ids"], r["loss_mask"]) if m) for r in found)


def test_clashing_columns_long_and_tied_turns(spark, tmp_path):
    """A conversation of most turns, very long texts, ties in the turn's number, and extra columns named as results."""
    from pyspark.sql import functions as F

    long = "word </turn> \\ été " * 60_000
    rows = [(5, k // 2, ("user", "assistant")[k % 2], f"turn {k} <body>") for k in range(3000)]
    rows += [(6, 0, "assistant", long), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (6, None, "user", "x" * 400_000), (7, 0, "", "")]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    docs.withColumns({c: F.lit(1) for c in ("ids", "formatted", "loss_mask", "n", "n_turns")}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op3(spark, str(tmp_path)).collect()}
    assert got == want(rows + [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])


def test_ids_of_long_segments_are_the_library_s(monkeypatch):
    t = chat._tokenizer(chat.default_tokenizer())
    texts = ["straße  été,\n\n tabs\t and   runs \u3000 of\u00a0 blanks " * 300, "x" * 50_000, " " * 3000, "a" + "  b" * 900, "\n" * 500 + "end", "word " * 4000, ""]
    for size in (64, 1000, 1 << 17):
        monkeypatch.setattr(chat, "PIECE", size)
        assert [x.tolist() for x in chat.encode(t, texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert all("".join(chat.pieces_of(x, size)) == x for x in texts)


def test_ids_of_ten_million_characters():
    t = chat._tokenizer(chat.default_tokenizer())
    text = "".join(f"word{k % 997}{' ' * (1 + k % 3)}and\n" for k in range(800_000))
    assert len(text) > 9_500_000
    got, = chat.encode(t, [text])
    assert max(map(len, chat.pieces_of(text, chat.PIECE))) <= chat.PIECE
    assert got.tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_segments_whole():
    import public_tokenizers

    assert chat._cuts(chat._tokenizer(chat.default_tokenizer()))
    assert not chat._cuts(chat._tokenizer(str(public_tokenizers.path("word_bpe_49k.json"))))
