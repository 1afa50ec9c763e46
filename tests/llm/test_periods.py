"""Periodic runs against a search of every period at every place."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import periods, queries

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch with its smallest period, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q) and not any(
                all(words[k] == words[k + r] for k in range(start, i + q - r)) for r in range(1, q)
            ):
                found[start, q] = i + q - start
    return sorted((start, length, q) for (start, q), length in found.items())


def brute_row(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a, original = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = original[a + (i - a) % p]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, doc_rows):
    found = queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).select(*COLUMNS)
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    short = [r for r in doc_rows if len(WORD.findall(r[1] or "")) < 3000]
    assert len(short) > 0.9 * len(doc_rows)
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    assert len(got) == len(doc_rows)
    assert any(row[1] for row in got.values())
    for row in short:
        assert got[row[0]] == brute_row(*row)


unit = st.lists(st.sampled_from("abcd"), min_size=1, max_size=6)
stretch = st.tuples(unit, st.integers(1, 50)).map(lambda x: (x[0] * 50)[: x[1]])
texts = st.lists(stretch, max_size=5).map(lambda parts: [w.encode() for part in parts for w in part])


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_runs_of_several_texts(many):
    got = list(periods.measure(many))
    assert len(got) == len(many)
    for words, (runs, kept) in zip(many, got):
        want = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        assert [tuple(r) for r in runs] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert kept == [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), unique=True, min_size=1))
def test_ordered_places(order):
    bucket, periods.BUCKET = periods.BUCKET, 8
    try:
        places, held = periods.OrderedPlaces(order[0]), [order[0]]
        for place in order[1:]:
            before, after = places.add(place)
            assert before == max((p for p in held if p < place), default=-1)
            assert after == min((p for p in held if p > place), default=-1)
            held.append(place)
        assert list(places) == sorted(held) and places.size == len(held)
    finally:
        periods.BUCKET = bucket


def test_batches_are_cut_between_texts():
    together, periods.TOGETHER = periods.TOGETHER, 50
    try:
        many = [[b"x", b"y"] * 20, [b"x"] * 70, [], [b"x", b"y"] * 20]
        assert [[tuple(r) for r in runs] for runs, _ in periods.measure(many)] == [[(0, 40, 2)], [(0, 70, 1)], [], [(0, 40, 2)]]
    finally:
        periods.TOGETHER = together


@pytest.mark.parametrize("words", [["a"] * 150_000, ["a", "b", "c"] * 50_000])
def test_very_long_runs(words):
    ((runs, kept),) = periods.measure([[w.encode() for w in words]])
    assert [tuple(r) for r in runs] == [(0, 150_000, len(set(words)))]
    assert len(kept) == len(set(words))


def test_odd_cases(spark, odd, twice, empty):
    got = {r["doc_id"]: r for r in periods.find_runs(odd).collect()}
    assert len(got) == odd.count()
    for doc_id, text, *_ in odd_rows():
        words = WORD.findall(text or "")
        assert got[doc_id]["n_words"] == len(words)
        if len(words) < 3000:
            assert [tuple(r) for r in got[doc_id]["runs"]] == brute_runs(words)
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 20000, 1)] and got[5]["collapsed"] == "again"
    assert got[1]["collapsed"] == got[2]["collapsed"] == got[3]["collapsed"] == ""
    assert periods.find_runs(twice).count() == twice.count()
    assert periods.find_runs(empty).count() == 0
    assert queries.planted_period(None, [b"a"]) == [b"a"]
