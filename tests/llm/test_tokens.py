"""Token files and packing."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing, token_files
from rankloom.llm.tokens import Encoder, vocabulary_path
from rankloom.session import fresh_path

BYTES, WORDS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
ODD_TEXTS = [
    "",
    " ",
    "a  b",
    " a b ",
    "don't  stop\n\n now   x",
    "x\x00y \x1c z",
    "<|endoftext|> a <|endoftext|>",
    "é ́ ñ Ünï ΣΑΣ Σ",
    "12 345 3.14 #!? ... …",
    "\t\r\n",
    "日本 語 テスト 🙂 x",
    "a b c　d",
]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def encoder(request):
    return Encoder(request.param)


def whole(encoder, text):
    return encoder.library.encode(text, add_special_tokens=False).ids


def test_encoding_equals_the_library_on_odd_texts(encoder, doc_rows):
    texts = ODD_TEXTS + [t for _, t in doc_rows[:60]]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == whole(encoder, text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t aBé'sñ1.,-́\x00<|>Σ日"), max_size=30))
def test_encoding_equals_the_library(text):
    for path in (BYTES, WORDS):
        one = test_encoding_equals_the_library.encoders.setdefault(path, Encoder(path))
        assert one.encode([text])[0].tolist() == whole(one, text)


test_encoding_equals_the_library.encoders = {}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 2**20 - 1), min_size=1, max_size=60), st.data())
def test_packing_bits_is_a_round_trip(bits, ids, data):
    ids = np.array(ids) % (1 << bits)
    payload = token_files.pack(ids, bits)
    assert len(payload) == (len(ids) * bits + 7) // 8
    start = data.draw(st.integers(0, len(ids) - 1))
    count = data.draw(st.integers(0, len(ids) - start))
    assert token_files.unpack(payload, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_width_is_the_fewest_bits():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def check_files(spark, docs, rows, **options):
    path = fresh_path(spark, "test_tokens")
    token_files.write_token_files(docs, path, BYTES, **options)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).collect())
    library, start, want = Encoder(BYTES), 0, []
    for doc_id, text in rows:
        ids = [*whole(library, text or ""), 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    return spark.read.parquet(path)


def test_token_files(spark, docs, doc_rows):
    blocks = check_files(spark, docs, doc_rows, block_ids=2000)
    for block in blocks.collect():
        assert block["bits"] == 16 and len(block["payload"]) == 2 * block["n_ids"]
        assert block["n_ids"] <= 2000 or len(block["doc_ids"]) == 1


def test_token_files_odd_cases(spark, odd, twice, empty):
    check_files(spark, odd, [r[:2] for r in odd_rows()])
    check_files(spark, empty, [])
    path = fresh_path(spark, "test_tokens")
    token_files.write_token_files(twice, path, BYTES)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(found) == twice.count() and found[0]["doc_id"] is None
    assert [r["start"] for r in found[1:]] == np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()


def check_packing(found, rows, capacity):
    library, pieces = Encoder(WORDS), {}
    for doc_id, text in rows:
        ids = [*whole(library, text or ""), 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            pieces[doc_id, k] = (start, len(part), zlib.crc32(part.tobytes()))
    got = found.collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(p[1] for p in pieces.values())
    return len(sequences), -(-total // capacity)


def test_packing_documents(docs, doc_rows):
    used, least = check_packing(packing.pack_documents(docs, WORDS), doc_rows, 4096)
    assert used <= least + 1


def test_packing_odd_cases(odd, twice, empty):
    check_packing(packing.pack_documents(odd, WORDS, capacity=512), [r[:2] for r in odd_rows()], 512)
    assert packing.pack_documents(empty, WORDS).count() == 0
    found = packing.pack_documents(twice, WORDS).where("piece = 0")
    assert found.count() == twice.count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65).astype(np.int64)
    used = np.zeros(65, np.int64)
    sequences = 0
    for parts, times in packing.plan(counts, 64):
        assert sum(parts) <= 64 and times > 0
        sequences += times
        for x in parts:
            used[x] += times
    assert used.tolist() == counts.tolist()
    assert sequences <= 2 * -(-sum(lengths) // 64)


def test_complements_are_found():
    counts = np.zeros(101, np.int64)
    for n, times in ((60, 5), (40, 2), (25, 3), (15, 3), (20, 3)):
        counts[n] = times
    plan = packing.plan(counts, 100)
    full = sum(times for parts, times in plan if sum(parts) == 100)
    assert full == 5  # twice 60+40, three times 60+25+15
