"""Removing repeated passages with FM-indexes over shards of the corpus.

Searching every document in the index of every shard would grow with the square
of the corpus. So text is dealt to shards by content: a passage of ``length``
words has an anchor (see ``anchors``), and all its occurrences have the same words
from the anchor on. Anchors whose core occurs nowhere else drop out first. Around
the others, equal surroundings are settled by their first occurrence, and one of
each goes to the shard named by its core.

A shard is indexed: suffix array, Burrows-Wheeler transform, and a wavelet matrix of
packed bits with sampled counts. Its documents' stretches are then streamed through
by backward search, last word first. When a match has grown past ``length`` words it
is shortened by moving to the interval of all suffixes that share ``length`` words,
so the state at each place is its matching statistic cut at ``length``. Intervals
that reach it and hold an earlier occurrence are reported, and their words removed.

A class with more than ``hot`` different surroundings is cut into single passages. Spark
finds the first of each by its digest, map-side, and joins it back, so that no shard
grows with the class or with the copies of one passage.

Cases: null and empty texts have no words; texts below ``length`` words keep all;
passages never cross documents; rows with one doc_id count as one place, so equal
rows are treated alike and do not remove each other; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import anchors, substrings
from rankloom.llm.arrow import map_batches
from rankloom.llm.repetition import suffix_ranks
from rankloom.llm.words import HASHES, mixed, words_of
from rankloom.session import materialise

TOGETHER = 500_000


class WaveletMatrix:
    """Counts of a symbol before a place, from one packed bit array per bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.planes = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int64)
            self.planes.append((words, before, int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` goes for ``symbol``; differences of two of these are counts."""
        for level, (words, before, zeros) in enumerate(self.planes):
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            place = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Index of stretches of words. Searched are stretches it holds, so a match never breaks off."""

    def __init__(self, stretches: list[np.ndarray], length: int):
        sizes = np.array([len(s) for s in stretches], np.int64)
        n_stretches, total = len(stretches), int(sizes.sum()) + len(stretches)
        ends = np.cumsum(sizes + 1) - 1
        self.vocabulary, symbols = np.unique(np.concatenate(stretches), return_inverse=True)
        is_word = np.ones(total, bool)
        is_word[ends] = False
        text = np.zeros(total, np.int64)
        text[is_word] = symbols + 1
        # For sorting, every separator is a symbol of its own before all words.
        ordered = np.where(is_word, text + n_stretches, 0)
        ordered[ends] = np.arange(n_stretches)
        levels = suffix_ranks(ordered)
        rank = levels[-1]
        self.suffixes = np.empty(total, np.int64)
        self.suffixes[rank] = np.arange(total)
        self.tree = WaveletMatrix(text[self.suffixes - 1])
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.starts = np.cumsum(counts) - counts
        alphabet = np.arange(len(counts))
        self.zero = self.tree.descend(alphabet, np.zeros(len(counts), np.int64))
        # Runs of suffixes that share `length` words.
        a, b = self.suffixes[:-1], self.suffixes[1:]
        same, at = np.ones(total - 1, bool), 0
        for k in range(len(levels) - 1, -1, -1):
            while length - at >= 1 << k:
                x, y = np.minimum(a + at, total - 1), np.minimum(b + at, total - 1)
                same &= (levels[k][x] == levels[k][y]) & (np.maximum(a, b) + at < total)
                at += 1 << k
        head = np.r_[True, ~same]
        first = np.flatnonzero(head)
        self.run = np.cumsum(head) - 1
        self.low, self.high = first, np.r_[first[1:], total]
        self.places, self.text, self.length = np.cumsum(sizes + 1) - sizes - 1, text, length

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Words as symbols of the index."""
        return np.searchsorted(self.vocabulary, words) + 1

    def step(self, symbol, low, high):
        """The interval of a match after one more word before it."""
        base = self.starts[symbol] - self.zero[symbol]
        return self.tree.descend(symbol, low) + base, self.tree.descend(symbol, high) + base

    def intervals(self, stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, start, run) of all matches of ``length`` words, all stretches searched side by side."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        symbols = self.symbols(np.concatenate(stretches))
        ends = np.cumsum(sizes)
        low = np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), len(self.text), np.int64)
        matched = np.zeros(len(sizes), np.int64)
        found = []
        for back in range(1, int(sizes.max(initial=0)) + 1):
            lane = np.flatnonzero(sizes >= back)
            a, b = self.step(symbols[ends[lane] - back], low[lane], high[lane])
            grown = matched[lane] + 1
            full = grown >= self.length
            run = self.run[np.minimum(a, len(self.run) - 1)]
            a, b = np.where(full, self.low[run], a), np.where(full, self.high[run], b)
            low[lane], high[lane], matched[lane] = a, b, np.minimum(grown, self.length)
            found.append((lane[full], sizes[lane[full]] - back, run[full]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _prepare(texts: list) -> list[np.ndarray]:
    return [HASHES.of(words_of(t)) for t in texts]


def _scan(docs: DataFrame, scheme: anchors.Scheme) -> DataFrame:
    def work(batches):
        for batch in batches:
            rows = list(zip(batch.column("row").to_pylist(), _prepare(batch.column("text").to_pylist())))
            for part in substrings._groups(rows, lambda r: len(r[1]), TOGETHER):
                units = np.concatenate([r[1] for r in part])
                bounds = np.cumsum([0, *(len(r[1]) for r in part)])
                prints = anchors.Prints(units)
                at = anchors.find(units, prints, bounds, scheme)
                owner = np.searchsorted(bounds, at, side="right") - 1
                low, high = bounds[owner], bounds[owner + 1]
                left = np.maximum(low, at - scheme.side)
                right = np.minimum(high, at + scheme.core + scheme.side)
                around = mixed(prints.of(left, right) + (at - left).astype(np.uint64))
                ids = np.array([r[0] for r in part], np.int64)
                core = prints.of(at, at + scheme.core)
                yield [ids[owner], (at - low).astype(np.int32), core.view(np.int64), around.view(np.int64)]

    return map_batches(docs.select("row", "text"), work, "row long, at int, cls long, around long")


def _stretches(texts: DataFrame, chosen: DataFrame, scheme: anchors.Scheme) -> DataFrame:
    """The words around chosen anchors, as hashes."""
    per_text = chosen.groupBy("row").agg(F.collect_list(F.struct("at", "cls")).alias("anchors"))

    def work(batches):
        for batch in batches:
            texts = _prepare(batch.column("text").to_pylist())
            docs, rows = (batch.column(c).to_pylist() for c in ("doc_id", "row"))
            for doc_id, row, words, found in zip(docs, rows, texts, batch.column("anchors").to_pylist()):
                out = []
                for a in found:
                    at = a["at"]
                    low, high = max(0, at - scheme.side), min(len(words), at + scheme.core + scheme.side)
                    out.append((a["cls"], doc_id, row, low, words[low:high].tobytes()))
                yield [list(c) for c in zip(*out)] if out else [[]] * 5

    return map_batches(
        texts.join(per_text, "row"), work, "cls long, doc_id long, row long, low int, content binary"
    )


def _pieces(texts: DataFrame, chosen: DataFrame, scheme: anchors.Scheme) -> DataFrame:
    """The digest of every single passage around chosen anchors."""
    per_text = chosen.groupBy("row").agg(F.collect_list("at").alias("anchors"))

    def work(batches):
        for batch in batches:
            texts = _prepare(batch.column("text").to_pylist())
            docs, rows = (batch.column(c).to_pylist() for c in ("doc_id", "row"))
            for doc_id, row, words, found in zip(docs, rows, texts, batch.column("anchors").to_pylist()):
                starts = set()
                for at in found:
                    low, high = max(0, at - scheme.side), min(len(words), at + scheme.core + scheme.side)
                    starts.update(range(low, high - scheme.length + 1))
                out = [(substrings.digest(words[k : k + scheme.length].tobytes()), doc_id, row, k) for k in starts]
                yield [list(c) for c in zip(*out)] if out else [[]] * 4

    return map_batches(texts.join(per_text, "row"), work, "piece binary, doc_id long, row long, start int")


def _later_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of single passages with an earlier occurrence. The first ones are written, so that Spark can
    split hot ones in the join."""
    pieces = materialise(pieces, "word_pieces")
    firsts = pieces.groupBy("piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("one"))
    firsts = materialise(firsts.where("n > 1").select("piece", "one"), "word_firsts")
    later = F.struct("doc_id", "start") > F.struct("one.doc_id", "one.start")
    found = pieces.join(firsts, "piece").where(later)
    return found.select("row", F.col("start").alias("first"), (F.col("start") + length).alias("last"))


def later_starts(members: list[tuple], length: int) -> list[np.ndarray]:
    """For members (doc_id, place of the content in its text, words) of a shard: the starts, within the
    content, of passages that start earlier in some member, by (doc_id, place)."""
    words = [np.frombuffer(m[2], np.uint64) for m in members]
    index = FMIndex(words, length)
    first_id = np.iinfo(np.int64).min  # a missing id comes before all others
    docs = np.array([first_id if m[0] is None else m[0] for m in members], np.int64)
    places = np.array([m[1] for m in members], np.int64)
    # The order of all indexed places in the corpus, and the first of each run of suffixes.
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + places[owner]
    order = np.lexsort((start, docs[owner]))
    key = np.empty(len(owner), np.int64)
    new = np.r_[True, (np.diff(docs[owner][order]) != 0) | (np.diff(start[order]) != 0)]
    key[order] = np.cumsum(new)
    first = np.minimum.reduceat(key[index.suffixes], index.low)
    stretch, at, run = index.intervals(words)
    own = key[index.places[stretch] + at]
    later = first[run] < own
    stretch, at = stretch[later], at[later]
    by_stretch = np.lexsort((at, stretch))
    cuts = np.searchsorted(stretch[by_stretch], np.arange(1, len(words)))
    return np.split(at[by_stretch], cuts)


def _search(stretches: DataFrame, length: int) -> DataFrame:
    """Spans of passages with an earlier occurrence. Each task indexes whole classes, a shard at a time."""

    def work(batches):
        for held in substrings.by_class(batches, ["cls", "doc_id", "row", "low", "content"]):
            members = [(doc_id, low, content) for _, doc_id, _, low, content in held]
            out = [
                (row, low + a, low + b + length)
                for (_, _, row, low, _), starts in zip(held, later_starts(members, length))
                for a, b in substrings.runs(starts)
            ]
            yield [list(c) for c in zip(*out)] if out else [[], [], []]

    shards = stretches.repartition("cls").sortWithinPartitions("cls")
    return map_batches(shards, work, "row long, first int, last int")


def _kept(texts: DataFrame, spans: DataFrame) -> DataFrame:
    per_text = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def work(batches):
        for batch in batches:
            out = []
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spans"))):
                words = words_of(text)
                turn = np.zeros(len(words) + 1, np.int64)
                ends = np.array([(s["first"], min(s["last"], len(words))) for s in found])
                np.add.at(turn, ends[:, 0], 1)
                np.add.at(turn, ends[:, 1], -1)
                gone = np.cumsum(turn[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((row, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield [list(c) for c in zip(*out)] if out else [[]] * 4

    rows = map_batches(texts.join(per_text, "row"), work, "row long, removed long, sha string, kept binary")
    return rows.dropDuplicates(["row"])


def remove_repeats(docs: DataFrame, length: int = 20, window: int = 14, gram: int = 4, hot: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where something was removed, the words left."""
    scheme = anchors.Scheme(length, window, gram)
    docs, unique = substrings.with_rows(docs)
    doc_ids = docs.select("doc_id", "row").distinct()

    def with_ids(df):
        return df.withColumn("doc_id", F.col("row")) if unique else df.join(doc_ids, "row")

    rows = materialise(_scan(docs, scheme), "word_anchors")
    rows = materialise(substrings.not_alone(rows, "cls"), "word_ranked")
    counted, chosen = substrings.surroundings(with_ids(rows), ["doc_id", "at", "row"])
    earlier = F.struct("doc_id", "at") > F.struct("one.doc_id", "one.at")
    settled = counted.where("n > 1").where(earlier).select(
        "row",
        F.greatest(F.col("at") - scheme.side, F.lit(0)).alias("first"),
        (F.col("at") + scheme.core + scheme.side).alias("last"),
    )
    chosen = materialise(chosen, "chosen")
    few, many = chosen.where(F.col("kinds") <= hot), chosen.where(F.col("kinds") > hot)
    texts = with_ids(substrings.texts_with(docs, few))
    found = settled.unionByName(_search(_stretches(texts, few, scheme), length))
    if not many.isEmpty():
        texts = with_ids(substrings.texts_with(docs, many))
        found = found.unionByName(_later_pieces(_pieces(texts, many, scheme), length))
    spans = materialise(found, "word_spans")
    changed = _kept(substrings.texts_with(docs, spans), spans)
    whole = _whole(docs)
    return whole.join(changed, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "all").alias("kept_sha256"),
        "kept",
    )


def _whole(docs: DataFrame) -> DataFrame:
    """Number of words and digest of every whole text."""

    def work(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("row"),
                [len(w) for w in words],
                [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
            ]

    return map_batches(docs.select("doc_id", "row", "text"), work, "doc_id long, row long, n_words long, all string")
