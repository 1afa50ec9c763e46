"""Near-duplicates with b-bit MinHash.

1. One pass over the texts gives each document its shingle set's size and
   fingerprint, band keys of its minima, and its signature: the low ``BITS`` bits
   of every minimum, packed into longs.
2. Documents with equal sets become one class, the smallest doc_id its name.
3. In each bucket of the first bands every class is compared with the bucket's
   smallest one. Candidates must have sizes that allow the similarity and an
   estimate, corrected for chance agreement of low bits, within five standard
   errors of it. What is left is confirmed on the full sets. Large groups of
   copies become one component here, at a few comparisons a member.
4. From then on only buckets with several components matter. Classes that share
   one and are in different components are compared too, cell by cell; those
   within the largest component of the bucket are not compared with each other.
   So every pair of every bucket is either compared or already connected.
5. Components of the confirmed links.

The chance that a pair at the very threshold of 0.8 shares no band is
(1 - 0.8^4)^24 = 3e-6; it falls fast above it.

Cases: a text without words has an empty set and is linked with nothing; one with
fewer words than a shingle is one shingle; rows with one doc_id belong together;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches
from rankloom.llm.components import components
from rankloom.llm.sizes import broadcast_if_small
from rankloom.llm.words import HASHES, lower_ascii, mixed, window_hashes, words_of
from rankloom.session import materialise

BANDS, ROWS, BITS = 24, 4, 4
#: Bands that connect large groups before the rest is looked at.
FIRST_BANDS = 3
#: Members of a bucket that meet in one task.
CELL = 4096
MINIMA = BANDS * ROWS
_SEEDS = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
_FACTORS, _OFFSETS = _SEEDS[:MINIMA] | np.uint64(1), _SEEDS[MINIMA:]
_LOWEST = sum(1 << k for k in range(0, 64, BITS))
_SIGNATURE = "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>, bits array<long>"


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z in lower case."""
    words = HASHES.of(words_of(text and _lower(text)))
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))) + np.uint64(min(size, len(words))))


def _lower(text: str) -> str:
    return lower_ascii(text.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x BANDS) and packed low bits (documents x MINIMA * BITS / 64) of non-empty sets."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = np.concatenate(sets)
    minima = np.empty((len(sets), MINIMA), np.uint64)
    for k in range(MINIMA):
        minima[:, k] = np.minimum.reduceat(values * _FACTORS[k] + _OFFSETS[k], starts)
    minima = mixed(minima)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mixed(keys * np.uint64(31) + minima[:, row::ROWS])
    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(len(sets), -1, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    return keys.view(np.int64), packed.view(np.int64)


def _sign(docs: DataFrame, size: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, packed = signatures([sets[k] for k in full]) if full else ([], [])
            bands, bits = [None] * len(ids), [None] * len(ids)
            for k, a, b in zip(full, keys, packed):
                bands[k], bits[k] = a, b
            prints = [(np.sum(mixed(s)), np.bitwise_xor.reduce(mixed(s + np.uint64(1)))) for s in sets]
            yield [
                ids,
                [len(s) for s in sets],
                np.array([p[0] for p in prints], np.uint64).view(np.int64),
                np.array([p[1] for p in prints], np.uint64).view(np.int64),
                bands,
                bits,
            ]

    return map_batches(docs.select("doc_id", "text"), work, _SIGNATURE)


def estimate(bits_a: str, bits_b: str) -> Column:
    """Similarity from the share of equal low-bit minima, less the agreement by chance."""
    longs = MINIMA * BITS // 64
    differ = [F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k]) for k in range(longs)]
    folded = [
        functools.reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, k) if k else x for k in range(BITS)]) for x in differ
    ]
    lanes = [F.bit_count(x.bitwiseAND(F.lit(_LOWEST))) for x in folded]
    equal = 1 - functools.reduce(Column.__add__, lanes) / MINIMA
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def _slack(similarity: float) -> float:
    chance = 1 / (1 << BITS)
    equal = chance + (1 - chance) * similarity
    return 5 * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


def _plausible(percent: int) -> Column:
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & (estimate("bits_a", "bits_b") >= percent / 100 - _slack(percent / 100))


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(
        F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")
    )


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The texts of chosen documents."""
    reps = broadcast_if_small(reps)
    texts = docs.select("doc_id", "text").join(reps, F.col("doc_id") == F.col("rep"), "left_semi")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            yield [
                batch.column("doc_id").cast(pa.int64()),
                [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()],
            ]

    return map_batches(texts, work, "rep long, members binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = materialise(pairs, "pairs")
    reps = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "reps")
    sets = materialise(_sets(_texts_of(docs, reps), size), "sets")

    def work(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield [[p[0] for p in out], [p[1] for p in out]]

    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialise(map_batches(joined, work, "a long, b long"), "confirmed")


def _stars(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and signatures leave open."""
    pairs = pairs.distinct().join(_side(classes, "a"), "a").join(_side(classes, "b"), "b")
    return pairs.where(_plausible(percent)).select("a", "b")


def _links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links."""
    first = classes.select("rep", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("key"))
    hubs = first.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    starred = first.join(materialise(hubs, "hubs"), "key").where("rep <> hub")
    pairs = starred.select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    links = _confirmed(docs, _stars(classes, pairs, percent), size, percent)
    found = materialise(components(links), "components")

    def placed(rows):
        return rows.join(found, rows.rep == found.node, "left").withColumn("component", F.coalesce("component", "rep"))

    several = F.min("component") < F.max("component")
    entries = placed(classes.select("rep", "bands")).select(
        "rep", "component", F.posexplode("bands").alias("band", "key")
    )
    keys = materialise(entries.groupBy("key").agg(several.alias("several")).where("several").select("key"), "open")
    members = materialise(entries.join(keys, "key"), "buckets")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")
    )
    rest = members.join(materialise(sizes, "largest"), "key").drop("band")
    more = _across(docs, rest, classes, size, percent)
    return found if more.isEmpty() else materialise(components(links.unionByName(more)), "components")


def _across(docs: DataFrame, rest: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, one for each class and component at least.

    A bucket is a table of all members against those outside its largest
    component, cut into cells of at most ``CELL`` by ``CELL``; a task holds one
    cell and gives back links only, never pairs. Estimates come first, full sets
    decide.
    """
    other = F.col("component") != F.col("largest")
    high = F.ceil(F.col("n") / CELL).cast("int")
    wide = F.greatest(F.ceil((F.col("n") - F.col("most")) / CELL).cast("int"), F.lit(1))
    own = F.xxhash64("rep")
    rows = rest.select(
        "key", "rep", "component", other.alias("other"), F.pmod(own, high).cast("int").alias("i"),
        F.pmod(own, wide).cast("int").alias("j"), high.alias("high"), wide.alias("wide"),
    )
    across = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.struct(F.col("i").alias("x"), j.alias("y")))
    down = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: F.struct(i.alias("x"), F.col("j").alias("y")))
    cells = F.array_distinct(F.when(F.col("other"), F.concat(across, down)).otherwise(across))
    rows = materialise(rows.withColumn("cell", F.explode(cells)).drop("high", "wide"), "unsettled")
    reps = materialise(rows.select("rep").distinct(), "reps")
    sets = _sets(_texts_of(docs, reps), size).join(classes.select("rep", "bits"), "rep")
    full = rows.join(materialise(sets, "sets"), "rep").repartition("key", "cell").sortWithinPartitions("key", "cell")

    def work(batches):
        for held in _cells(batches):
            found = _cell_links(held, percent)
            yield [[a for a, _ in found], [b for _, b in found]]

    return materialise(map_batches(full, work, "a long, b long"), "across").distinct()


def _cells(batches):
    """The rows of one cell after the other."""
    columns = ["key", "cell", "rep", "component", "other", "i", "j", "members", "bits"]
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and (row[0] != held[0][0] or row[1] != held[0][1]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cell_links(held: list[tuple], percent: int) -> list[tuple[int, int]]:
    x, y = held[0][1]["x"], held[0][1]["y"]
    every = [r for r in held if r[5] == x]
    others = [r for r in held if r[4] and r[6] == y]
    if not every or not others:
        return []
    sets = [np.frombuffer(r[7], np.uint64) for r in every]
    sizes = np.array([len(s) for s in sets])
    reps, comps = (np.array([r[k] for r in every]) for k in (2, 3))
    bits = np.array([r[8] for r in every], np.int64).view(np.uint64)
    lowest, chance, similarity = np.uint64(_LOWEST), 1 / (1 << BITS), percent / 100
    least = chance + (1 - chance) * (similarity - _slack(similarity))
    out = []
    for row in others:
        own = np.frombuffer(row[7], np.uint64)
        n = len(own)
        differ = bits ^ np.array(row[8], np.int64).view(np.uint64)
        folded = differ.copy()
        for k in range(1, BITS):
            folded |= differ >> np.uint64(k)
        equal = 1 - np.bitwise_count(folded & lowest).sum(axis=1) / MINIMA
        open_ = (comps != row[3]) & (equal >= least) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        values = np.concatenate([sets[k] for k in at])
        place = np.minimum(np.searchsorted(own, values), n - 1)
        starts = np.cumsum(sizes[at]) - sizes[at]
        common = np.add.reduceat((own[place] == values).astype(np.int64), starts)
        linked = at[100 * common >= percent * (sizes[at] + n - common)]
        # One link to a component says all there is to say.
        _, first = np.unique(comps[linked], return_index=True)
        out += [(row[2], int(reps[k])) for k in linked[first]]
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the document's class for every document."""
    signed = materialise(_sign(docs, size), "signatures")
    classes = materialise(
        signed.where("n_shingles > 0")
        .groupBy("print1", "print2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands")),
        "classes",
    )
    found = _links(docs, classes, size, percent)
    keys = ["print1", "print2", "n_shingles"]
    out = signed.join(classes.select(*keys, "rep"), keys, "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("rep", "doc_id").alias("class_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; rows with one doc_id become one.

    Rows without a doc_id stay.
    """
    found = near_duplicates(docs, size, percent)
    dropped = materialise(found.where("NOT kept").select("doc_id").distinct(), "dropped")
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    rest = docs.join(broadcast_if_small(dropped), "doc_id", "left_anti").select(docs.columns)
    if not twice.isEmpty():
        named = rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        rest = named.unionByName(rest.where("doc_id IS NULL"))
    return rest
