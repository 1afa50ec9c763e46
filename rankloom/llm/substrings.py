"""Removing repeated byte strings by fingerprints around anchors, in place of prefix doubling.

Which ``length`` bytes start again elsewhere is what a suffix array shows; with
places enough for every byte it would be many times the input. Here only anchors
(see ``anchors``) are looked at, and no ranks are sorted:

1. One scan takes fingerprints of an anchor's first 50 bytes and of the stretches
   behind them, each end at double the last, until the core is passed. Spark counts
   the first, drops anchors that are alone, and goes on with the hash of (name so
   far, next fingerprint). Only equality matters, and the last name is the class of
   anchors with equal cores.
2. Anchors of a class whose whole surroundings are equal too are settled: every
   string around them repeats. One of each such group goes on.
3. Of the rest the surroundings are fetched, and all strings of the full length
   around a class's anchors are compared by their hashes. A class with more than
   ``hot`` different surroundings is cut into single strings first, which Spark counts
   by their digest, map-side, and joins back.
4. Bytes covered by repeated strings are removed.

Texts are read twice: once for the anchors, once for those documents that have
anchors left. Equality rests on 64-bit fingerprints of the parts.

Cases: a null or empty text has no bytes; matches never cross documents; text
over and over within a document repeats with itself; repeated rows repeat each
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import anchors
from rankloom.llm.arrow import map_batches
from rankloom.llm.sizes import broadcast_if_small
from rankloom.llm.words import mixed
from rankloom.session import materialise

_UNITS = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes of texts that are searched for anchors together.
TOGETHER = 1_000_000


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _groups(rows: list, size_of, limit: int = TOGETHER):
    part, size = [], 0
    for row in rows:
        if part and size + size_of(row) > limit:
            yield part
            part, size = [], 0
        part.append(row)
        size += size_of(row)
    if part:
        yield part


def levels_of(core: int, first: int = 50) -> list[int]:
    """Ends of the stretches that are ranked one after the other: doubling, the last ends the core."""
    ends = [first]
    while ends[-1] * 2 < core:
        ends.append(ends[-1] * 2)
    return [e for e in ends if e < core] + [core]


def _scan(docs: DataFrame, scheme: anchors.Scheme, ends: list[int]) -> DataFrame:
    """Anchor rows, and for each text one row with ``at`` null."""
    ranks = ", ".join(f"r{k} long" for k in range(len(ends)))

    def work(batches):
        for batch in batches:
            rows = list(zip(batch.column("row").to_pylist(), map(_raw, batch.column("text").to_pylist())))
            for part in _groups(rows, lambda r: len(r[1])):
                raw = np.frombuffer(b"".join(r[1] for r in part), np.uint8)
                bounds = np.cumsum([0, *(len(r[1]) for r in part)])
                units = _UNITS[raw]
                prints = anchors.Prints(units)
                at = anchors.find(units, prints, bounds, scheme)
                owner = np.searchsorted(bounds, at, side="right") - 1
                low, high = bounds[owner], bounds[owner + 1]
                stops = [0, *ends]
                found = [prints.of(at + a, at + b) for a, b in zip(stops[:-1], stops[1:])]
                left = np.maximum(low, at - scheme.side)
                right = np.minimum(high, at + scheme.core + scheme.side)
                around = mixed(prints.of(left, right) + (at - left).astype(np.uint64))
                ids = np.array([r[0] for r in part], np.int64)
                yield [ids[owner], (at - low).astype(np.int32), *(x.view(np.int64) for x in (*found, around))]

    return map_batches(docs.select("row", "text"), work, f"row long, at int, {ranks}, around long")


def not_alone(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs again. The keys are written first, so that Spark can split hot ones in the join."""
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return rows.join(materialise(again, "again"), key, "left_semi")


def surviving_anchors(docs: DataFrame, scheme: anchors.Scheme, ends: list[int]) -> DataFrame:
    """Anchors whose core occurs again, with ``cls`` naming the core."""
    rows = materialise(_scan(docs, scheme, ends), "anchors")
    rank = F.col("r0")
    for k in range(len(ends)):
        if k:
            rank = F.xxhash64(rank, f"r{k}")
        rows = materialise(not_alone(rows.withColumn("rank", rank), "rank").drop("rank"), "ranked")
    return rows.withColumn("cls", rank).select("row", "at", "cls", "around")


def surroundings(rows: DataFrame, first: list[str]) -> tuple[DataFrame, DataFrame]:
    """(anchors with how often their surroundings occur, one anchor of each surrounding in mixed classes).

    ``first`` names the columns whose smallest value picks the one.
    """
    groups = materialise(
        rows.groupBy("cls", "around").agg(F.count("*").alias("n"), F.min(F.struct(*first)).alias("first")), "around"
    )
    kinds = materialise(groups.groupBy("cls").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed_classes = groups.join(kinds, "cls").select("cls", "around", "n", "kinds", "first.*")
    counted = rows.join(groups.select("cls", "around", "n", F.col("first").alias("one")), ["cls", "around"])
    return counted, mixed_classes


def texts_with(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row and text of the documents that ``rows`` name."""
    ids = broadcast_if_small(materialise(rows.select("row").distinct(), "ids"))
    return docs.select("row", "text").join(ids, "row", "left_semi")


def _contexts(texts: DataFrame, chosen: DataFrame, scheme: anchors.Scheme) -> DataFrame:
    """The bytes around chosen anchors."""
    per_text = chosen.groupBy("row").agg(F.collect_list(F.struct("at", "cls", "n")).alias("anchors"))

    def work(batches):
        for batch in batches:
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "anchors"))):
                raw, out = _raw(text), []
                for a in found:
                    at = a["at"]
                    low = max(0, at - scheme.side)
                    high = min(len(raw), at + scheme.core + scheme.side)
                    out.append((a["cls"], row, at, low, a["n"], raw[low:high]))
                yield [list(c) for c in zip(*out)] if out else [[]] * 6

    return map_batches(
        texts.join(per_text, "row"), work, "cls long, row long, at int, low int, n long, content binary"
    )


def digest(piece: bytes) -> bytes:
    """Name of a single string; there may be billions, so 128 bits."""
    return hashlib.blake2b(piece, digest_size=16).digest()


def _pieces(texts: DataFrame, chosen: DataFrame, scheme: anchors.Scheme) -> DataFrame:
    """The digest of every single string around chosen anchors, with the anchor's place in it."""
    per_text = chosen.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("anchors"))

    def work(batches):
        for batch in batches:
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "anchors"))):
                raw, out = _raw(text), []
                for a in found:
                    at = a["at"]
                    low = max(0, at - scheme.side)
                    high = min(len(raw), at + scheme.core + scheme.side)
                    for start in range(low, high - scheme.length + 1):
                        out.append((digest(raw[start : start + scheme.length]), at - start, row, start, a["n"]))
                yield [list(c) for c in zip(*out)] if out else [[]] * 5

    return map_batches(texts.join(per_text, "row"), work, "piece binary, ahead int, row long, start int, n long")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of single strings that occur again. The repeated names are written first, so that Spark can
    split hot ones in the join."""
    pieces = materialise(pieces, "pieces")
    again = pieces.groupBy("piece", "ahead").agg(F.sum("n").alias("times")).where("times > 1").select("piece", "ahead")
    found = pieces.join(materialise(again, "again"), ["piece", "ahead"], "left_semi")
    return found.select("row", F.col("start").alias("first"), (F.col("start") + length).alias("last"))


def repeated_starts(members: list[tuple], length: int) -> list[np.ndarray]:
    """For members (class, place of the anchor in the content, times, content) the starts, within
    the content, of the strings that occur more than once among the members of the class.

    Strings of one class are equal only if the anchor is at the same place in
    them, so one such place is looked at after the other, in all members at once.
    """
    size = np.array([len(m[3]) for m in members], np.int64)
    anchor = np.array([m[1] for m in members], np.int64)
    times = np.array([m[2] for m in members], np.int64)
    name = mixed(np.array([m[0] for m in members], np.int64).view(np.uint64))
    width = int(size.max(initial=0))
    raw = np.zeros((len(members), width), np.uint8)
    for k, m in enumerate(members):
        raw[k, : len(m[3])] = np.frombuffer(m[3], np.uint8)
    sums = anchors.prefix_prints(_UNITS[raw])
    rows, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for ahead in range(int(anchor.max(initial=0)), -1, -1):
        start = anchor - ahead
        at = np.flatnonzero((start >= 0) & (start + length <= size))
        if len(at) < 2 and not (times[at] > 1).any():
            continue
        key = mixed(anchors.stretch_prints(sums, at, start[at], length) + name[at])
        _, place = np.unique(key, return_inverse=True)
        again = at[np.bincount(place, times[at])[place] > 1]
        rows.append(again)
        starts.append(start[again])
    row = np.concatenate(rows)
    # The starts of a member came in rising order, which a stable sort keeps.
    ordered = np.concatenate(starts)[np.argsort(row, kind="stable")]
    return np.split(ordered, np.cumsum(np.bincount(row, minlength=len(members)))[:-1]) if members else []


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending numbers as (first, last) of their runs."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), starts[np.r_[breaks, len(starts) - 1]].tolist()))


def by_class(batches, columns: list[str]):
    """Rows sorted by class, as lists that hold whole classes."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if len(held) >= 2048 and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings found by comparing the surroundings of a class."""

    def work(batches):
        for held in by_class(batches, ["cls", "row", "at", "low", "n", "content"]):
            members = [(cls, at - low, n, content) for cls, _, at, low, n, content in held]
            out = [
                (row, low + a, low + b + length)
                for (_, row, _, low, _, _), starts in zip(held, repeated_starts(members, length))
                for a, b in runs(starts)
            ]
            yield [list(c) for c in zip(*out)] if out else [[], [], []]

    together = contexts.repartition("cls").sortWithinPartitions("cls")
    return map_batches(together, work, "row long, first int, last int")


def with_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id and text with ``row``, which tells the rows apart, and whether that is the doc_id.

    Where ids repeat or are missing it is a hash of id and text, so equal rows share it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    unique = odd.isEmpty()
    return docs.withColumn("row", F.col("doc_id") if unique else F.xxhash64("doc_id", "text")), unique


def _kept(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of the texts that have spans."""
    per_text = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def work(batches):
        for batch in batches:
            out = []
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spans"))):
                raw = np.frombuffer(_raw(text), np.uint8)
                turn = np.zeros(len(raw) + 1, np.int64)
                ends = np.array([(s["first"], min(s["last"], len(raw))) for s in found])
                np.add.at(turn, ends[:, 0], 1)
                np.add.at(turn, ends[:, 1], -1)
                gone = np.cumsum(turn[:-1]) > 0
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = raw[~gone].tobytes()
                out.append((row, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            yield [list(c) for c in zip(*out)] if out else [[]] * 5

    schema = "row long, removed long, spans long, sha string, kept binary"
    # Repeated rows come with equal spans, so one of each says all.
    return map_batches(texts.join(per_text, "row"), work, schema).dropDuplicates(["row"])


def repeated_spans(docs: DataFrame, scheme: anchors.Scheme, hot: int) -> DataFrame:
    """(row, first, last) of repeated strings, for documents with ``row``; the last may pass the text's end."""
    rows = surviving_anchors(docs, scheme, levels_of(scheme.core))
    counted, chosen = surroundings(rows, ["row", "at"])
    settled = counted.where("n > 1").select(
        "row",
        F.greatest(F.col("at") - scheme.side, F.lit(0)).alias("first"),
        (F.col("at") + scheme.core + scheme.side).alias("last"),
    )
    chosen = materialise(chosen, "chosen")
    few, many = chosen.where(F.col("kinds") <= hot), chosen.where(F.col("kinds") > hot)
    found = settled.unionByName(_compare(_contexts(texts_with(docs, few), few, scheme), scheme.length))
    if not many.isEmpty():
        found = found.unionByName(_counted(_pieces(texts_with(docs, many), many, scheme), scheme.length))
    return materialise(found, "spans")


def remove_repeats(
    docs: DataFrame, length: int = 400, window: int = 200, gram: int = 8, hot: int = 20_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where something was removed, the bytes left."""
    docs, _ = with_rows(docs)
    spans = repeated_spans(docs, anchors.Scheme(length, window, gram), hot)
    changed = _kept(texts_with(docs, spans), spans)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select("doc_id", "row", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("all"))
    return whole.join(changed, "row", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "all").alias("kept_sha256"),
        "kept",
    )
