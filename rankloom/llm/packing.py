"""Packing token pieces into sequences by exact complements, then best fit.

Only lengths decide a packing, and there are at most ``capacity`` of them. Their
counts, a table of at most ``capacity`` rows however large the corpus, go to the
driver, which settles how many sequences get which lengths. Pieces then find
their place by their rank among the pieces of the same length.

Cases: a null text counts as empty; every document has its end id, so it has at
least one piece; repeated rows are packed once each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches
from rankloom.llm.tokens import encoder
from rankloom.session import materialise


class _Available:
    """Counts by length, with the complements that are still to be had."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()

    def times(self, lengths: list[int]) -> int:
        return min(int(self.n[x]) // c for x, c in Counter(lengths).items())

    def pair(self, gap: int, held: list[int]) -> list[int] | None:
        """The two lengths adding up to ``gap``, the first as large as it can be."""
        low = np.arange((gap + 1) // 2, gap)
        # At most two lengths are held, so at most two candidates can be blocked by them: three tries are enough.
        for a in low[(self.n[low] > 0) & (self.n[gap - low] > 0)][::-1][:3].tolist():
            if self.times([*held, a, gap - a]):
                return [a, gap - a]
        return None

    def fill(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that fill ``gap`` exactly beside ``held``."""
        if self.n[gap] and self.times([*held, gap]):
            return [gap]
        if found := self.pair(gap, held):
            return found
        for a in np.flatnonzero(self.n[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            if found := self.pair(gap - a, [*held, a]):
                return [a, *found]
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), all pieces used once.

    Longest first: as long as one, two or three other lengths fill the rest
    exactly they are used up together, as often as the scarcest allows. What has
    no complement goes, longest first, to the fullest sequence with room.
    """
    have, done, rest = _Available(counts), [], np.zeros_like(counts)
    if have.n[capacity]:
        done.append(([capacity], int(have.n[capacity])))
        have.n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while have.n[length]:
            found = have.fill(capacity - length, [length])
            if found is None:
                rest[length], have.n[length] = have.n[length], 0
                break
            used = [length, *found]
            times = have.times(used)
            for x in used:
                have.n[x] -= times
            done.append((used, times))
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, np.int64)

    def keep(space, lengths, times):
        if times:
            room[space].append((lengths, times))
            spaces[space] += times

    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                each = min(capacity // length, left)
                keep(capacity - each * length, [length] * each, left // each)
                left %= each
                continue
            space = length + int(fits[0])
            lengths, times = room[space].pop()
            spaces[space] -= times
            each = min(space // length, max(1, left // times))
            used = min(times, left // each)
            keep(space, lengths, times - used)
            keep(space - each * length, lengths + [length] * each, used)
            left -= used * each
    return done + [x for groups in room.values() for x in groups]


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset), sorted by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for length, each in Counter(lengths).items():
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its number among the pieces of that length in its task."""

    def pieces(batches):
        enc, context = encoder(vocabulary), TaskContext.get()
        task, seen = context.partitionId() if context else 0, [0] * (capacity + 1)
        for batch in batches:
            out = [[] for _ in range(7)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                raw = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(ids) + 1
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, piece, start, length, crc, task, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return map_batches(docs.select("doc_id", "text"), pieces, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    pieces = materialise(cut_pieces(docs, vocabulary, end_id, capacity), "pieces")
    by_task = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece_counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    # A few rows for each length, so bounded by the capacity as well.
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batches):
        table = places.value
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, each, sequence, offset = table[np.searchsorted(key, (length << 44) + rank, side="right") - 1].T
            nth = rank - first
            yield [*batch.columns[:5], sequence + nth // each, offset + nth % each * length]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, place, schema)
