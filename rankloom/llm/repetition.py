"""Quality rules on repeated substrings, found with suffix arrays over words.

Suffixes of all documents of a batch are sorted together by prefix doubling;
the document is part of a word's first rank, so nothing matches across
documents. Suffixes that are already alone drop out. Longest common prefixes of
neighbours give the intervals of suffixes that share at least ``min_words``
words; the longest match of each place with a neighbour is its longest repeat,
and the union of these spans is what repeats cover.

A document is kept if it passes the base rules, repeats cover at most
``max_covered`` of its words, and no repeat is longer than ``max_longest`` words.

Cases: a null or empty text has no words and is rejected (too short); a text of
one word over and over is handled in log(length) passes; repeated rows are judged
each; other columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.arrow import map_batches, short_batches, slices
from rankloom.llm.words import SPACES, words_of
from rankloom.session import ship_package

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words of a batch that are sorted together.
TOGETHER = 400_000


def suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, ... words, until every place is alone.

    A rank is the number of smaller places, so places that are alone keep it.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    heads = np.r_[True, first[order][1:] != first[order][:-1]]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    levels, step = [ranks], 1
    active = _shared(order, heads)
    while len(active):
        before = levels[-1]
        beyond = active + step
        then = np.where(beyond < n, before[np.minimum(beyond, n - 1)], -1) + 1
        key = before[active] * (n + 1) + then
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = before[active]
        group = np.r_[True, old[1:] != old[:-1]]
        heads = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(active))
        start = np.maximum.accumulate(np.where(group, place, 0))
        head = np.maximum.accumulate(np.where(heads, place, 0))
        ranks = before.copy()
        ranks[active] = old + head - start
        levels.append(ranks)
        active = _shared(active, heads)
        step *= 2
    return levels


def _shared(order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places whose group holds more than one."""
    alone = heads & np.r_[heads[1:], True]
    return order[~alone]


def _alike(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of the suffixes at ``a`` and ``b``."""
    n, common = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    return common


def longest_repeats(first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place the words of its longest repeat (0 if below ``min_words``), and the
    longest common prefixes of neighbours in suffix order (0 at the borders of intervals)."""
    out = np.zeros(len(first), np.int64)
    if not len(first):
        return out, out
    levels = suffix_ranks(first)
    start = max(0, min_words.bit_length() - 1)
    if start >= len(levels):
        return out, out[:0]
    ranks = levels[start]
    often = np.bincount(ranks, minlength=len(ranks))[ranks] > 1
    places = np.flatnonzero(often)
    places = places[np.argsort(levels[-1][places])]
    common = _alike(levels, places[:-1], places[1:])
    common[common < min_words] = 0
    out[places[1:]] = common
    out[places[:-1]] = np.maximum(out[places[:-1]], common)
    return out, common


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which places lie in the span of some place: the union of the spans."""
    n = len(lengths)
    at = np.flatnonzero(lengths)
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, at, 1)
    np.add.at(turn, np.minimum(at + lengths[at], n), -1)
    return np.cumsum(turn[:n]) > 0


METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def measure(
    texts: list[str | None], min_words: int = 4, max_covered: float = 0.35, max_longest: int = 120
) -> list[np.ndarray]:
    """The columns of ``METRICS``."""
    out = [[] for _ in METRICS.split(", ")]
    for part in _parts(texts):
        for column, values in zip(out, _measure(part, min_words, max_covered, max_longest)):
            column.append(values)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def _parts(texts) -> Iterator[list]:
    part, size = [], 0
    for text in texts:
        words = words_of(text)
        if part and size + len(words) > TOGETHER:
            yield part
            part, size = [], 0
        part.append((text or "", words))
        size += len(words)
    if part:
        yield part


def _measure(part, min_words, max_covered, max_longest):
    counts = np.array([len(w) for _, w in part], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for _, ws in part for w in ws), np.int64, counts.sum())
    owner = np.repeat(np.arange(len(part)), counts)
    longest, _ = longest_repeats(owner * max(1, len(number)) + ids, min_words)
    windows = np.where(longest >= WINDOW, WINDOW, 0)
    per_text = lambda flags: np.bincount(owner, flags, len(part)).astype(np.int64)
    repeat_words, covered_words = per_text(covered(windows)), per_text(covered(longest))
    top = np.zeros(len(part), np.int64)
    np.maximum.at(top, owner, longest)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t, _ in part], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t, _ in part], np.int64)
    lines = np.array([_repeated_lines(t) for t, _ in part], np.int64)
    failed = (counts < 20) | (100 * repeat_words > 30 * counts)
    kept = ~failed & (covered_words <= max_covered * counts) & (top <= max_longest)
    return counts, chars, symbols, lines, repeat_words, covered_words, top, failed, kept


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repetition_metrics(docs: DataFrame, **limits) -> DataFrame:
    """doc_id with the columns of ``METRICS`` for every document."""

    def work(batches):
        for batch in batches:
            yield [batch.column("doc_id").cast(pa.int64()), *measure(batch.column("text").to_pylist(), **limits)]

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id long, {METRICS}")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns."""

    def work(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(measure(texts, **limits)[-1]))

    ship_package(docs.sparkSession)
    short_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
