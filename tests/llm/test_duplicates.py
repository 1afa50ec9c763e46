"""Near-duplicates, repeated bytes, repeated passages."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from rankloom.llm import anchors, components, fm_index, minhash, substrings, words

LETTERS = "abcdefgh"


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def check_near(found, rows, size, percent=80):
    want = brute.near_duplicates(rows, size, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == want


def test_near_duplicates_match_all_pairs(docs, doc_rows):
    check_near(minhash.near_duplicates(docs, size=4), doc_rows, 4)


def test_chains_and_stragglers_are_linked(spark):
    """Neighbours of a chain are similar, its ends are not; one bucket's smallest member must not decide alone."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(4000)]
    texts = []
    for start in (0, 1000, 2000):
        for step in range(12):
            texts.append(" ".join(pool[start + 12 * step : start + 12 * step + 160]))
    texts += [" ".join(rng.choice(pool) for _ in range(100)) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check_near(minhash.near_duplicates(make(spark, texts), size=5), rows, 5)


def test_large_group_of_near_copies_makes_few_pairs(spark):
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(400):
        own = list(base)
        own[k % 300] = f"own{k}"
        texts.append(" ".join(own))
    found = minhash.near_duplicates(make(spark, texts), size=5).collect()
    assert {r["component_id"] for r in found} == {0}


def test_near_duplicates_odd_cases(odd, twice, empty):
    rows = [r[:2] for r in odd_rows()]
    check_near(minhash.near_duplicates(odd, size=5), rows, 5)
    found = minhash.near_duplicates(twice, size=5)
    assert found.count() == twice.count()
    assert {r["component_id"] for r in found.where("doc_id IN (7, 8)").collect()} == {6}
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(twice)
    assert kept.columns == twice.columns
    ids = [r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(ids) == len(set(ids)) and 7 not in ids and 8 not in ids and 6 in ids
    assert minhash.keep_one(empty).count() == 0


def test_estimate_follows_the_similarity(spark):
    sets = [np.arange(s, s + 1000, dtype=np.uint64) for s in (0, 111, 500)]
    _, bits = minhash.signatures([words.mixed(s) for s in sets])
    rows = [(bits[0].tolist(), bits[k].tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "bits_a array<long>, bits_b array<long>")
    got = [r[0] for r in df.select(minhash.estimate("bits_a", "bits_b")).collect()]
    assert got[0] == 1 and abs(got[1] - 0.8) < 0.2 and abs(got[2] - 1 / 3) < 0.25


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*path, *star, (200, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_share_an_anchor(seed):
    rng = np.random.default_rng(seed)
    scheme = anchors.Scheme(20, 9, 3)
    units = words.mixed(rng.integers(0, 4, 400).astype(np.uint64))
    units[200:240] = units[50:90]
    found = set(anchors.find(units, anchors.Prints(units), np.array([0, 120, 400]), scheme).tolist())
    for start in range(50, 71):
        assert any(x in found and x + 150 in found for x in range(start, start + scheme.window))


def random_texts(seed, n):
    """Texts that share stretches, also at their borders and within themselves."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(10, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(LETTERS) for _ in range(30)))
        texts.append("".join(parts))
    return [*texts, "", None, "a" * 200, "ab" * 90, texts[0], "é" + shared[0] * 2]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeated_bytes_match_all_windows(spark, hot):
    rows = list(enumerate(random_texts(11, 40)))
    found = substrings.remove_repeats(make(spark, [t for _, t in rows]), length=40, window=15, gram=4, hot=hot)
    got = [tuple(r)[1:5] for r in found.orderBy("doc_id").collect()]
    assert got == brute.repeated_bytes(rows, 40)


def test_repeated_bytes_of_documents(docs, doc_rows):
    found = substrings.remove_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in found] == brute.repeated_bytes(doc_rows, 400)


def test_repeated_bytes_odd_cases(odd, twice, empty):
    rows = [r[:2] for r in odd_rows()]
    got = [tuple(r)[1:5] for r in substrings.remove_repeats(odd, 200, 100).orderBy("doc_id").collect()]
    assert got == brute.repeated_bytes(rows, 200)
    assert substrings.remove_repeats(twice).count() == twice.count()
    assert substrings.remove_repeats(empty).count() == 0


def random_passages(seed, n):
    rng = random.Random(seed)
    shared = [[rng.choice(LETTERS) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(LETTERS) for _ in range(12)]
        texts.append(" ".join(parts))
    return [*texts, "", None, "a " * 60, "a b " * 30, texts[0]]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeated_passages_match_all_windows(spark, hot):
    rows = list(enumerate(random_passages(3, 50)))
    found = fm_index.remove_repeats(make(spark, [t for _, t in rows]), length=8, window=5, gram=2, hot=hot)
    assert [tuple(r)[1:4] for r in found.orderBy("doc_id").collect()] == brute.repeated_words(rows, 8)


def test_repeated_passages_odd_cases(odd, twice, empty):
    rows = [r[:2] for r in odd_rows()]
    got = [tuple(r)[1:4] for r in fm_index.remove_repeats(odd).orderBy("doc_id").collect()]
    assert got == brute.repeated_words(rows, 20)
    assert fm_index.remove_repeats(twice).count() == twice.count()
    assert fm_index.remove_repeats(empty).count() == 0


def test_fm_index_counts(spark):
    rng = np.random.default_rng(1)
    stretches = [rng.integers(0, 3, rng.integers(1, 15)).astype(np.uint64) for _ in range(12)]
    index = fm_index.FMIndex(stretches, 4)
    for size in (1, 2, 3):
        pattern = stretches[0][:size] if len(stretches[0]) >= size else stretches[1][:size]
        low, high = np.array([0]), np.array([len(index.text)])
        for word in index.symbols(pattern)[::-1]:
            low, high = index.step(np.array([word]), low, high)
        want = sum((s[i : i + len(pattern)] == pattern).all() for s in stretches for i in range(len(s) - len(pattern) + 1))
        assert high[0] - low[0] == want


def test_removed_text_is_returned(spark):
    text = " ".join(f"w{i}" for i in range(40))
    found = fm_index.remove_repeats(make(spark, [text, "x y " + text + " z"])).where("n_removed > 0").first()
    assert found["kept"].decode() == "x y z" and found["n_removed"] == 40
    assert found["doc_id"] == 1 and F is not None


def test_cloud_of_near_copies_matches_all_pairs(spark, monkeypatch):
    """Copies with many or few edits of one text: some are linked to few others, some to none."""
    monkeypatch.setattr(minhash, "CELL", 32)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(160):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 12)):
            own[at] = f"e{k}x{at}"
        texts.append(" ".join(own))
    found = minhash.near_duplicates(make(spark, texts), size=4)
    check_near(found, list(enumerate(texts)), 4)
    assert 1 < len({r["component_id"] for r in found.collect()}) < 160


def test_no_task_gathers_the_copies_of_a_hot_passage(spark, monkeypatch):
    """One passage in ever other surroundings: its copies are counted by Spark and reach no shard."""
    shared = " ".join(f"s{k}" for k in range(12))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(9))} {shared} {' '.join(f'b{i}x{k}' for k in range(9))}") for i in range(60)]
    reached = []
    for module, name in ((fm_index, "_search"), (substrings, "_compare")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, length, f=whole: (reached.append(df.count()), f(df, length))[1])
    docs = make(spark, [t for _, t in rows])
    found = fm_index.remove_repeats(docs, length=8, window=5, gram=2, hot=10)
    assert [tuple(r)[1:4] for r in found.orderBy("doc_id").collect()] == brute.repeated_words(rows, 8)
    found = substrings.remove_repeats(docs, length=30, window=15, gram=4, hot=10)
    assert [tuple(r)[1:5] for r in found.orderBy("doc_id").collect()] == brute.repeated_bytes(rows, 30)
    assert len(reached) == 2 and max(reached) < 60


def test_repeated_starts_of_many_members():
    """Members of several classes, one of them there twice: what a plain count of strings finds, in rising order."""
    from collections import Counter

    import numpy as np

    from rankloom.llm.substrings import repeated_starts

    text, length = np.random.default_rng(3).integers(97, 99, 60, dtype=np.uint8).tobytes(), 12
    members = [(c, 20 - low, times, text[low:high]) for c, low, high, times in
               [(1, 0, 40, 1), (1, 5, 50, 1), (1, 18, 33, 1), (2, 3, 30, 2), (2, 9, 31, 1), (3, 0, 60, 1)]]
    seen = Counter()
    for c, anchor, times, content in members:
        for start in range(len(content) - length + 1):
            if start <= anchor:
                seen[c, anchor - start, content[start : start + length]] += times
    want = [
        [s for s in range(len(x) - length + 1) if s <= at and seen[c, at - s, x[s : s + length]] > 1]
        for c, at, _, x in members
    ]
    assert [found.tolist() for found in repeated_starts(members, length)] == want
    assert repeated_starts([], length) == []
