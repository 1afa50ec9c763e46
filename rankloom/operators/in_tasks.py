"""Pair counts and score sums that are made inside tasks, over Arrow batches.

Pairs and single contributions are far more rows than what they come from or
lead to. Rows with whole lists are shuffled instead, so that everything that
belongs to one answer meets in one task; the task unfolds the lists, adds up and
cuts to the best k there. Work is dealt by counts: a task gets a bounded number of
pairs or contributions, and their number of tasks follows the data. Much of it goes in
several rounds, each with a part of the blocks or groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from rankloom.operators.indexes import dense_index
from rankloom.session import materialise, ship_package

#: Ordered pairs and contributions that one task unfolds.
PAIRS, CONTRIBUTIONS = 16_000_000, 4_000_000
#: Pairs whose keys are held before they are counted, and unfolded at once.
KEYS_HELD, UNFOLDED = 20_000_000, 2_000_000
#: Entries of baskets or lists that are shuffled in one round, and the most rounds.
SHUFFLED, ROUNDS = 250_000_000, 8
#: Codes up to which a task has a table of item sizes.
TABLE = 1 << 24
LAST_INT = (1 << 31) - 1
LOW = (1 << 32) - 1
#: An odd factor; the high bits of the product spread codes over blocks.
SPREAD = 2_654_435_769


def tasks_for(spark, work: float, per_task: int) -> int:
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(work / per_task))


def rounds_for(entries: float) -> int:
    return min(ROUNDS, max(1, math.ceil(entries / SHUFFLED)))


def in_rounds(some: Callable[[int], DataFrame], rounds: int, name: str) -> DataFrame:
    """The rows of ``some(0)``, ``some(1)``, ... Several are written one after the other, so that the disk holds one
    round's shuffle at a time."""
    if rounds == 1:
        return some(0)
    return functools.reduce(DataFrame.unionByName, [materialise(some(turn), name) for turn in range(rounds)])


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (ByteType, ShortType, IntegerType, LongType))


def fits_int(df: DataFrame, *columns: str) -> bool:
    """Whether all values are integers from 0 to 2^31 - 1, which take half the bytes of longs."""
    if not all(is_integral(df, c) for c in columns):
        return False
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    return all((ends[f"low_{c}"] or 0) >= 0 and (ends[f"high_{c}"] or 0) <= LAST_INT for c in columns)


# --- pairs of items of one user ---------------------------------------------


def block_of(code, tasks: int):
    """The block of a code from 0 to 2^31 - 1, the same for columns and arrays."""
    spread = code * SPREAD
    if isinstance(code, Column):
        return F.shiftright(spread.bitwiseAND(F.lit(LOW)) * F.lit(tasks), 32)
    return (spread & LOW) * tasks >> 32


def best_neighbours(seen: DataFrame, pairs: float, k: int) -> DataFrame:
    """ITEM_ID, SIMILAR_ID, score, rank from (USER_ID, ITEM_ID, n), distinct, n being the item's users.

    Items are dealt over blocks. A block gets the whole baskets of the users that hold
    one of its items, each basket once; so no pair is ever shuffled.
    """
    spark, kind = seen.sparkSession, seen.schema["ITEM_ID"].dataType
    ship_package(spark)
    index = None
    if fits_int(seen, "ITEM_ID"):
        coded = seen.withColumn("code", F.col("ITEM_ID").cast("int"))
    else:
        index = materialise(dense_index(seen, "ITEM_ID", "item-order"), "item-codes")
        coded = seen.join(index.withColumnRenamed("index", "code"), "ITEM_ID")
    tasks, rounds = tasks_for(spark, pairs, PAIRS), rounds_for(pairs)
    size = coded.agg(F.max("n").alias("most"), F.max("code").alias("last")).first()
    n = F.col("n").cast("short" if (size.most or 0) < 1 << 15 else "int")
    held = F.collect_list(F.struct("code", n.alias("n"), block_of(F.col("code").cast("long"), tasks).alias("block")))
    baskets = coded.where(F.col("USER_ID").isNotNull()).groupBy("USER_ID").agg(held.alias("held"))
    baskets = baskets.select(
        F.col("held.code").alias("codes"), F.col("held.n").alias("counts"), F.array_distinct("held.block").alias("blocks")
    )
    if rounds > 1:
        baskets = materialise(baskets, "baskets")

    def some(turn: int) -> DataFrame:
        mine = F.filter("blocks", lambda b: b % rounds == turn) if rounds > 1 else F.col("blocks")
        dealt = baskets.select(F.explode(mine).alias("block"), "codes", "counts")
        dealt = dealt.repartitionById(-(-tasks // rounds), F.floor(F.col("block") / rounds).cast("int"))
        return dealt.mapInArrow(_count_pairs(k, tasks, size.last or 0), "a int, b int, score double, rank long")

    best = in_rounds(some, rounds, "near-part")
    if index is None:
        return best.select(F.col("a").cast(kind).alias("ITEM_ID"), F.col("b").cast(kind).alias("SIMILAR_ID"), "score", "rank")
    return (
        best.join(index.select(F.col("index").alias("a"), "ITEM_ID"), "a")
        .join(index.select(F.col("index").alias("b"), F.col("ITEM_ID").alias("SIMILAR_ID")), "b")
        .select("ITEM_ID", "SIMILAR_ID", "score", "rank")
    )


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _unfold(batch: pa.RecordBatch, tasks: int) -> Iterator[np.ndarray]:
    """Keys (item, item of the basket) for the items of the row's block, some at a time; an item meets itself too."""
    codes, held = flat(batch.column("codes"))
    codes, held = codes.astype(np.int64), held.astype(np.int64)
    own = np.flatnonzero(block_of(codes, tasks) == np.repeat(batch.column("block").to_numpy(), held))
    row = np.repeat(np.arange(len(held)), held)[own]
    items, starts, widths = codes[own] << 32, (np.cumsum(held) - held)[row], held[row]
    ends = np.cumsum(widths)
    at = 0
    while at < len(own):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UNFOLDED, "right")))
        width = widths[at:until]
        place = np.arange(width.sum())
        place += np.repeat(starts[at:until] - (np.cumsum(width) - width), width)
        keys = np.repeat(items[at:until], width)
        keys |= codes[place]
        yield keys
        at = until


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and how often each is there. Without counts the keys are sorted where they are."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts
    return keys[first], times.astype(np.int64)


class Sizes:
    """Users of each item, by code: a table while codes are small, sorted pairs beyond."""

    def __init__(self, last: int):
        self.table = np.zeros(last + 1, np.int32) if last < TABLE else None
        self.pairs = np.empty(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        if self.table is not None:
            self.table[codes] = counts
        else:
            more = counted(codes.astype(np.int64) << 32 | counts.astype(np.int64))[0]
            self.pairs = counted(np.concatenate([self.pairs, more]))[0]

    def of(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes].astype(float)
        return (self.pairs[np.searchsorted(self.pairs, codes << 32)] & LOW).astype(float)


def _count_pairs(k: int, tasks: int, last: int):
    def work(batches) -> Iterator[pa.RecordBatch]:
        waiting, held, keys, times, sizes = [], 0, np.empty(0, np.int64), np.empty(0, np.int64), Sizes(last)

        def take_in():
            new = np.concatenate(waiting)
            waiting.clear()
            more, often = counted(new)
            return counted(np.concatenate([keys, more]), np.concatenate([times, often])) if len(keys) else (more, often)

        for batch in batches:
            sizes.add(flat(batch.column("codes"))[0], flat(batch.column("counts"))[0])
            for some in _unfold(batch, tasks):
                waiting.append(some)
                held += len(some)
                # Beyond the keys at hand, so that a very frequent item's pairs are merged few times.
                if held >= max(KEYS_HELD, 2 * len(keys)):
                    keys, times = take_in()
                    held = 0
        if waiting:
            keys, times = take_in()
        if len(keys):
            yield from _best_pairs(keys, times, sizes, k)

    return work


def _best_pairs(keys: np.ndarray, times: np.ndarray, sizes: Sizes, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each item among counted pairs, by score as ``cosine`` rounds it, then id."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] >> 32) != (keys[:-1] >> 32)]))
    bounds = np.append(starts, len(keys))
    at = 0
    while at < len(starts):  # some items at a time; an item's pairs stay together
        until = max(at + 1, int(np.searchsorted(bounds, bounds[at] + UNFOLDED, "right")) - 1)
        some, c = keys[bounds[at] : bounds[until]], times[bounds[at] : bounds[until]]
        width = np.diff(bounds[at : until + 1])
        a, b, group = some >> 32, some & LOW, np.repeat(np.arange(until - at), width)
        size_a = np.repeat(sizes.of(keys[starts[at:until]] >> 32), width)
        other = a != b
        a, b, group, c, size_a = a[other], b[other], group[other], c[other], size_a[other]
        score = np.floor(c / np.sqrt(size_a * sizes.of(b)) * 1e6 + 0.5).astype(np.int64)
        order, rank = best_places(group, score, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[order].astype(np.int32)), pa.array(b[order].astype(np.int32)), pa.array(score[order] / 1e6), pa.array(rank)],
            names=["a", "b", "score", "rank"],
        )
        at = until


def best_places(group: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best ``k`` rows of each group and their ranks; groups rise, equal scores keep their order."""
    n = len(group)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best, place_bits = score.max(), n.bit_length()
    score_bits = int(best - score.min()).bit_length() if score.dtype.kind == "i" else 64
    if int(group[-1]).bit_length() + score_bits + place_bits < 64:  # all in one number, which sorts faster
        order = (group << score_bits | best - score) << place_bits | np.arange(n)
        order.sort()
        order &= (1 << place_bits) - 1
    else:
        order = np.lexsort((-score, group))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) + 1
    return order[rank <= k], rank[rank <= k].astype(np.int64)


# --- sums of contributions ---------------------------------------------------


def best_sums(rows: DataFrame, group: str, id: str, k: int, kinds: tuple[str, str], own: str | None = None) -> DataFrame:
    """group, id, score, rank: the best ``k`` ids of each group by summed score, within each task.

    ``rows`` have columns ``group``, ``id`` and ``score``, each a value or a list; lists
    are as long as the others of their row. All contributions to one (group, id) must lie in
    one partition. Ids in the column ``own`` are left out for the group of its row. Sums are
    rounded as ``round6`` does. ``kinds`` are the types of group and id. An integer score counts millionths.
    """
    ship_package(rows.sparkSession)
    schema = f"`{group}` {kinds[0]}, `{id}` {kinds[1]}, score double, rank long"
    return rows.mapInArrow(_add_up(group, id, k, own), schema)


def _coded(values) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, nulls first, and the values by code."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _plain(values) -> bool:
    """Whether all values are integers from 0 to 2^31 - 1."""
    if not pa.types.is_integer(values.type) or values.null_count or not len(values):
        return False
    ends = pc.min_max(values).as_py()
    return ends["min"] >= 0 and ends["max"] <= LAST_INT


def _add_up(group: str, id: str, k: int, own: str | None):
    def work(batches) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = [c for c in (group, id, "score") if pa.types.is_list(table.schema.field(c).type)]
        lengths = pc.fill_null(pc.list_value_length(table[lists[0]]), 0).to_numpy()
        row = np.repeat(np.arange(table.num_rows), lengths)

        def entries(column: str):
            return pc.list_flatten(table[column]) if column in lists else table[column].take(row)

        ids, names, marks = entries(id), None, None
        if _plain(ids):  # such ids are their own codes
            kind, codes = ids.type, ids.to_numpy().astype(np.int64)
            if own:
                marks = pc.fill_null(table[own].cast(pa.int64()), -1).to_numpy()
        else:
            if own:
                ids = pa.concat_arrays([*ids.chunks, *table[own].cast(ids.type).chunks])
            codes, names = _coded(ids)
            if own:
                codes, marks = np.split(codes, [len(codes) - table.num_rows])
        if group in lists:
            groups, group_names = _coded(entries(group))
        else:
            of_row, group_names = _coded(table[group])
            groups = of_row[row]
        if not len(codes):
            return
        scores = entries("score")
        # Millionths stay whole numbers.
        score = scores.to_numpy().astype(np.int64 if pa.types.is_integer(scores.type) and not scores.null_count else float)
        id_bits = int(codes.max()).bit_length()
        key = groups << id_bits | codes
        score_bits = int(score.max()).bit_length() if score.dtype.kind == "i" and score.min() >= 0 else 64
        if int(groups.max()).bit_length() + id_bits + score_bits < 64:  # all in one number, which sorts faster
            key = key << score_bits | score
            key.sort()
            key, score = key >> score_bits, key & ((1 << score_bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, score = key[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, total = key[first], np.add.reduceat(score, first)
        if total.dtype.kind == "f":
            unit = 1e6 if pa.types.is_integer(scores.type) else 1.0
            total = np.floor(total / unit * 1e6 + 0.5) / 1e6
        if own:
            known = (marks >= 0) & (marks < 1 << id_bits)
            marks = of_row[known] << id_bits | marks[known]
            at = np.minimum(np.searchsorted(key, marks), len(key) - 1)
            fresh = np.ones(len(key), bool)
            fresh[at[key[at] == marks]] = False
            key, total = key[fresh], total[fresh]
        best, rank = best_places(key >> id_bits, total, k)
        found = pa.array(key[best] & ((1 << id_bits) - 1))
        found = found.cast(kind) if names is None else names.take(found)
        total = total[best] / 1e6 if total.dtype.kind == "i" else total[best]
        columns = [group_names.take(pa.array(key[best] >> id_bits)), found, total, rank]
        for at in range(0, len(best), 100_000):
            part = [pa.array(c[at : at + 100_000]) if isinstance(c, np.ndarray) else c.slice(at, 100_000) for c in columns]
            yield pa.RecordBatch.from_arrays(part, names=[group, id, "score", "rank"])

    return work


def whole_millionths(scores: DataFrame) -> bool:
    """Whether every score is a number of millionths below 80, so that 25 of them add up within an int."""
    near = F.abs(F.col("score") * 1e6 - F.round(F.col("score") * 1e6)) < 1e-6
    odd = scores.where(~near | (F.abs("score") > 80) | F.col("score").isNull() | F.isnan("score"))
    return odd.limit(1).count() == 0
