from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import common, tokenbin
from quillspark.llm.tokenbin import Encoder, pack, unpack

FILE = str(public_tokenizers.path("word_bpe_49k.json"))


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.data())
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(bits, values, data):
    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    payload = pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert unpack(payload, bits, a, b).tolist() == ids[a:b].tolist()


def test_too_wide_an_id():
    with pytest.raises(ValueError):
        pack(np.array([8], np.uint32), 3)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


@given(st.lists(st.one_of(st.none(), st.text(), st.text("abcÉÉ .,!'sΣİ<|endoftext|>\n ")), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chunks_encode_as_whole_texts(encoder, found):
    found = [x if x is None else x.encode("utf-8", "replace").decode() for x in found]
    ids, n = encoder.encode(pa.array(found, pa.string()))
    want = [encoder.chunks.tokenizer.encode(x or "", add_special_tokens=False).ids for x in found]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "x<|startoftext|>y", "Don't stop.", "$$$", "a.b,c!", "ÉTÉ?", "ﬁ ½", "日本語。", "'s", "a b"])
def test_odd_chunks(encoder, text):
    assert encoder.encode(pa.array([text]))[0].tolist() == encoder.chunks.tokenizer.encode(text, add_special_tokens=False).ids


def test_rows_from_files(spark, sf):
    tokenizer = Tokenizer.from_file(FILE)
    found = sorted(tokenbin.op5(spark, sf).collect(), key=lambda r: r["start"])
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    want: dict = {}
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in found] == [r[0] for r in docs]
    for r in found:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]


def test_random_access(spark, sf, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    tokenbin.write(docs, path, FILE)
    whole = [x for r in sorted(tokenbin.read_ids(spark, path, 0, 10**9).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    part = [x for r in sorted(tokenbin.read_ids(spark, path, 90, 1200).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    assert part == whole[90:1200]
    tokenizer = Tokenizer.from_file(FILE)
    assert whole == [x for r in docs.orderBy("doc_id").collect() for x in [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]]


def thue_morse(n: int) -> str:
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_chunks_that_collide_in_polynomial_hashes(encoder, n):
    found = [thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))]
    ids, counts = encoder.encode(pa.array(found))
    want = [encoder.chunks.tokenizer.encode(x, add_special_tokens=False).ids for x in found]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_equal_hashes_are_told_apart():
    """With a hash that only knows a word's length, every chunk still has its own ids."""
    enc = Encoder(FILE)
    whole = enc.hasher

    def poor(data, edges):
        begins, ends, _, words = whole(data, edges)
        return begins, ends, (ends - begins).astype(np.uint64), words

    enc.hasher = poor
    found = ["one two six ten", None, "two one", "alpha gamma delta sigma", "six"]
    for _ in range(2):
        ids, n = enc.encode(pa.array(found))
        want = [enc.chunks.tokenizer.encode(x or "", add_special_tokens=False).ids for x in found]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_long_texts_are_cut_behind_blanks(encoder):
    r = np.random.default_rng(1)
    found = ["ab", " ".join(map(str, r.integers(0, 5000, 900_000))), "x" * 50_000 + " y", ""]
    column = pa.array(found)
    sizes = [len(d) for _, _, d, _ in common.parts(column, 1 << 16)]
    assert max(sizes) <= 1 << 16 and sum(sizes) == sum(map(len, found))
    ids, n = encoder.encode(column)
    want = [encoder.chunks.tokenizer.encode(x, add_special_tokens=False).ids for x in found]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@given(st.lists(st.text("ab \n.é", max_size=300), max_size=5), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_hashes_by_windows(found, size):
    """Words hash alike wherever they stand and whatever the windows and parts."""
    hasher, small = common.WordHasher(), common.WordHasher()
    small.WINDOW = size
    held: dict = {}
    for h in (hasher, small):
        for a, b, data, edges in common.parts(pa.array(found, pa.string()), 64):
            begins, ends, hashes, cut = h(data, edges)
            for x, y, v in zip(begins, ends, hashes.tolist()):
                assert held.setdefault(data[x:y].tobytes(), v) == v
            assert len(cut) == len(edges)
    assert len(set(held.values())) == len(held)
    assert set(held) == {w for x in found for w in x.encode().split()}


def test_common_chunks_outlive_a_full_memory(monkeypatch):
    """What comes again and again is worked out once, however many rare chunks come between, and all ids are right."""
    monkeypatch.setattr(tokenbin, "CACHE_CHUNKS", 60)
    monkeypatch.setattr(tokenbin, "CACHE_PARTS", 60)
    enc = Encoder(FILE)
    asked, whole = [], enc.chunks.ids_of
    enc.chunks.ids_of = lambda chunks: (asked.extend(chunks), whole(chunks))[1]
    for k in range(40):
        found = [f"the common, words été {'x' * 70} of all texts", " ".join(f"rare{k}x{j}" for j in range(20)), None]
        ids, n = enc.encode(pa.array(found))
        want = [enc.chunks.tokenizer.encode(x or "", add_special_tokens=False).ids for x in found]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert asked.count(b"common,") == 1 and len(asked) == 40 * 20 + 8
    assert enc.table.n <= 90 and len(enc.chunks.parts) <= 90
