"""Periodic runs of words: a stretch that repeats itself at least four times in a row.

A run with smallest period q and n words is a pair of suffixes, at its start and
q words later, that share exactly n - q words. Suffixes are sorted by prefix
doubling, all documents of a batch together, and the classes of suffixes that
share at least so many words are united by falling longest common prefix, as
Kruskal unites trees: union-find names the class, and each class keeps its places
in order. Two places of a union that become neighbours were in no class before
and no third place of the class lies between them, so their distance, if it is
within their common prefix, is the smallest period of the stretch from the first
to the end of the common prefix. The pair is the seed of a run if the word before
breaks the period. The smaller set is always put into the larger.

Cases: a null or empty text has no words, no runs and an empty ``collapsed``; one
word over and over, or a very long text, is one run or few, found in
n * log(n) steps (a text is held whole by its task); runs may overlap and the same
words may be in several; repeated rows are judged each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.arrow import map_batches
from rankloom.llm.repetition import suffix_ranks
from rankloom.llm.words import words_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: What the suffixes of a run share at least: six words of period one less that one.
LEAST_COMMON = LEAST_WORDS - 1
#: Words of a batch that are sorted together, and places of a bucket before it is cut in two.
TOGETHER, BUCKET = 400_000, 2_000

RUNS = "array<struct<start: long, length: long, period: long>>"
Reword = Callable[[int | None, list[bytes]], list[bytes]]


class OrderedPlaces:
    """Places in ascending order, in buckets so that one more costs little however many there are."""

    __slots__ = ("buckets", "firsts", "size")

    def __init__(self, place: int):
        self.buckets, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for bucket in self.buckets:
            yield from bucket

    def add(self, place: int) -> tuple[int, int]:
        """The places just before and after the new one, -1 for none."""
        at = max(bisect(self.firsts, place) - 1, 0)
        bucket = self.buckets[at]
        k = bisect(bucket, place)
        before = bucket[k - 1] if k else -1
        if k < len(bucket):
            after = bucket[k]
        else:
            after = self.firsts[at + 1] if at + 1 < len(self.firsts) else -1
        bucket.insert(k, place)
        self.size += 1
        if not k:
            self.firsts[at] = place
        if len(bucket) > BUCKET:
            rest = bucket[BUCKET // 2 :]
            del bucket[BUCKET // 2 :]
            self.buckets.insert(at + 1, rest)
            self.firsts.insert(at + 1, rest[0])
        return before, after


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share, from the ranks by 1, 2, 4, ... words."""
    n, shared = len(levels[0]), np.zeros(len(a), np.int64)
    for power in reversed(range(len(levels))):
        x, y = a + shared, b + shared
        same = (np.maximum(x, y) < n) & (levels[power].take(x, mode="clip") == levels[power].take(y, mode="clip"))
        shared[same] += 1 << power
    return shared


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that share ``LEAST_COMMON`` words with another, in suffix order, and what
    each shares with the next; 0 at the end of a class."""
    levels = suffix_ranks(words)
    power = LEAST_COMMON.bit_length() - 1
    if power >= len(levels):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.flatnonzero(np.bincount(levels[power], minlength=len(words))[levels[power]] > 1)
    places = places[np.argsort(levels[-1][places])]
    shared = np.append(common_prefixes(levels, places[:-1], places[1:]), 0)[: len(places)]
    shared[shared < LEAST_COMMON] = 0
    used = (shared > 0) | (np.r_[0, shared[:-1]] > 0)
    return places[used], shared[used]


def adjacencies(places: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, next place, shared words) for each two places that become neighbours in a
    class, at a distance within what they share."""
    at = places.tolist()
    parent = list(range(len(at)))
    sets: list[OrderedPlaces | None] = [None] * len(at)

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    falling = np.argsort(-shared, kind="stable")[: np.count_nonzero(shared)]
    for k, common in zip(falling.tolist(), shared[falling].tolist()):
        one, other = root(k), root(k + 1)
        large, small = sets[one] or OrderedPlaces(at[one]), sets[other] or OrderedPlaces(at[other])
        if large.size < small.size:
            large, small = small, large
        sets[one], sets[other], parent[other] = large, None, one
        added = list(small)
        for place, before_it, after_it in zip(added, [-1, *added[:-1]], [*added[1:], -1]):
            before, after = large.add(place)
            # Neighbours that came along from the smaller set are not new.
            if before >= 0 and before != before_it and place - before <= common:
                yield before, place, common
            if after >= 0 and (after_it < 0 or after < after_it) and after - place <= common:
                yield place, after, common


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    seeds = np.array(list(adjacencies(*neighbours(words))), np.int64).reshape(-1, 3)
    start, period = seeds[:, 0], seeds[:, 1] - seeds[:, 0]
    length = period + seeds[:, 2]
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    first = (start == 0) | (words[start - 1] != words[start + period - 1])
    found = np.stack([start, length, period], axis=1)[long & first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:n]) > 0


def measure(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs and kept words of each text."""
    part, size = [], 0
    for words in texts:
        if part and size + len(words) > TOGETHER:
            yield from _measure(part)
            part, size = [], 0
        part.append(words)
        size += len(words)
    yield from _measure(part)


def _measure(part):
    counts = np.array([len(w) for w in part], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in part for w in ws), np.int64, counts.sum())
    # The text is part of a word, so nothing is shared across texts.
    ids += np.repeat(np.arange(len(part)), counts) * max(1, len(number))
    runs = runs_of(ids) if len(ids) else np.empty((0, 3), np.int64)
    kept = ~repeated(len(ids), runs)
    ends = np.cumsum(counts)
    of_text = np.searchsorted(ends, runs[:, 0], side="right")
    runs[:, 0] -= (ends - counts)[of_text]
    cuts = np.searchsorted(of_text, np.arange(len(part) + 1))
    for k, words in enumerate(part):
        left = kept[ends[k] - counts[k] : ends[k]]
        mine = runs[cuts[k] : cuts[k + 1]].tolist()
        yield mine, words if not mine else [w for w, keep in zip(words, left.tolist()) if keep]


def find_runs(docs: DataFrame, reword: Reword | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed: the words without those
    that a run contains after its first period, joined by one space.

    ``reword`` may replace the words of a document before they are looked at.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if reword is not None:
                texts = [reword(doc_id, words) for doc_id, words in zip(ids, texts)]
            runs, left = [], []
            for mine, kept in measure(texts):
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in mine])
                left.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield [ids, [len(w) for w in texts], runs, left]

    layout = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    return map_batches(docs.select("doc_id", "text"), work, layout)
