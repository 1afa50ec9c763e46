"""Whitening of embeddings from exact cross-products, by bit slices.

An entry c counts as the integer x = floor(1024 c) + 100000. Less the smallest x
of its dimension it is a short bit string; the bits of one place, of one
dimension, over 64 rows make a word. The popcount of the AND of two words is how
often both bits are set, so weighted by the places the popcounts add up to the
cross-product of two dimensions, exactly. Tasks send one sum per pair of
dimensions, cut in 32-bit pieces so that Spark can add them as longs however
large the sums are. The driver gets the square of the dimension in sums, never
rows; it centres them as integers (n * sum of products - product of sums) and
hands the covariance to ``eigh``.

Cases: rows whose vector is null, or holds a null or non-finite entry, drop out,
and so do entries whose x is no long; a vector shorter than the longest one lacks
entries, which counts as nulls. Repeated rows are rows of their own, null ids
stay. Equal eigenvalues come in the order of ``eigh``. A component without
variance (fewer rows than dimensions, constant dimensions) has null in
``whitened`` and is left out of ``identity_error``. An empty table, or one without
a usable vector, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches
from rankloom.session import materialise

SCALE, SHIFT = 1024, 100_000
#: Rows that are sliced together: 256 words a bit plane.
SLICE = 64 * 256
#: Entries beyond this have no x.
LARGEST = 2.0**63 / SCALE / 2
#: Eigenvalues below this share of the largest are rounding errors.
TINY = 1e-10
COMPONENTS = 8


@dataclass(frozen=True)
class Bounds:
    """Rows, and per dimension the sum, least and greatest of x."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    greatest: tuple[int, ...]


@dataclass(frozen=True)
class Whitening:
    """The components, by falling eigenvalue, as rows of ``vectors``."""

    bounds: Bounds
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of ``size`` entries, and their x as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    held = lengths[lengths >= 0]
    flat = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    entries = flat[np.repeat(held == size, held)].reshape(-1, size)
    usable = (np.abs(entries) < LARGEST).all(axis=1)
    return np.flatnonzero(lengths == size)[usable], np.floor(SCALE * entries[usable]).astype(np.int64) + SHIFT


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums per dimension as Python integers."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return high.sum(axis=0).astype(object) * (1 << 26) + low.sum(axis=0).astype(object)


def pieces(value: int) -> Iterator[tuple[int, int]]:
    """(place, piece): the value is the sum of piece * 2 ** (32 * place); pieces have the sign of the value."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & 0xFFFFFFFF:
            yield place, sign * (rest & 0xFFFFFFFF)
        rest, place = rest >> 32, place + 1


def bounds_of(df: DataFrame, vector: str) -> Bounds | None:
    """One pass over the vectors; None if none is usable."""

    def work(batches):
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            for size in set(pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist()) - {0}:
                _, x = integers(column, size)
                if not len(x):
                    continue
                n, sums, least, greatest = found.setdefault(size, [0, 0, x[0], x[0]])
                found[size] = [
                    n + len(x), sums + column_sums(x), np.minimum(least, x.min(axis=0)), np.maximum(greatest, x.max(axis=0)),
                ]
        for size, (n, sums, least, greatest) in found.items():
            rows = [(k, 0, 0, n) for k in range(size)]
            rows += [(k, *piece, 0) for k in range(size) for piece in pieces(int(sums[k]))]
            dims, places, parts, counts = zip(*rows)
            yield [[size] * len(rows), dims, places, parts, counts, least[list(dims)].tolist(), greatest[list(dims)].tolist()]

    parts = map_batches(
        df.select(vector), work, "size int, dim int, place int, piece long, n long, least long, greatest long"
    )
    longest = parts.groupBy("size", "dim", "place").agg(
        F.sum("piece").alias("piece"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")
    )
    rows = longest.toArrow().to_pylist()  # a few rows for each dimension
    size = max((r["size"] for r in rows), default=0)
    rows = [r for r in rows if r["size"] == size]
    if not size:
        return None
    sums = [0] * size
    for r in rows:
        sums[r["dim"]] += r["piece"] << (32 * r["place"])
    heads = sorted((r["dim"], r["least"], r["greatest"]) for r in rows if r["place"] == 0)
    n = next(r["n"] for r in rows if r["place"] == 0)
    return Bounds(n, tuple(sums), tuple(h[1] for h in heads), tuple(h[2] for h in heads))


class Slices:
    """Adds up the cross-products of the shifted integers for every pair of dimensions, in 32-bit pieces."""

    def __init__(self, bounds: Bounds):
        self.least = np.array(bounds.least, np.int64).view(np.uint64)
        widths = [(b - a).bit_length() for a, b in zip(bounds.least, bounds.greatest)]
        self.dim = np.repeat(np.arange(len(widths)), widths)
        self.bit = np.arange(len(self.dim)) - np.repeat(np.cumsum([0, *widths[:-1]]), widths)
        self.first = np.cumsum([0, *widths])
        self.places = 2 * max(widths) // 32 + 2
        self.sums = np.zeros((len(widths), len(widths), self.places), np.int64)
        self.held: list[np.ndarray] = []
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.rows += len(x)
        if self.rows >= SLICE:
            self.flush()

    def planes(self, x: np.ndarray) -> np.ndarray:
        """One row of words for each bit of each dimension."""
        shifted = np.ascontiguousarray((x.view(np.uint64) - self.least).T)
        out = np.zeros((len(self.dim), -(-len(x) // 64) * 8), np.uint8)
        for k, (dim, bit) in enumerate(zip(self.dim, self.bit.astype(np.uint64))):
            packed = np.packbits(((shifted[dim] >> bit) & np.uint64(1)).astype(np.uint8))
            out[k, : len(packed)] = packed
        return out.view(np.uint64)

    def flush(self) -> None:
        if not self.rows:
            return
        x = np.concatenate(self.held)
        self.held, self.rows = [], 0
        for start in range(0, len(x), SLICE):
            words = self.planes(x[start : start + SLICE])
            for k, (dim, bit) in enumerate(zip(self.dim, self.bit)):
                others = slice(self.first[dim], None)  # this dimension and those after it
                both = np.bitwise_count(words[others] & words[k]).sum(axis=1, dtype=np.int64)
                place, weight = np.divmod(self.bit[others] + bit, 32)
                cell = self.dim[others] * self.places + place
                heads = np.flatnonzero(np.diff(cell, prepend=-1))
                self.sums[dim].reshape(-1)[cell[heads]] += np.add.reduceat(both << weight, heads)
            for k in range(self.places - 1):
                self.sums[:, :, k + 1] += self.sums[:, :, k] >> 32
                self.sums[:, :, k] &= 0xFFFFFFFF

    def products(self) -> tuple[np.ndarray, ...]:
        """i, j, place, piece of the sums of products, for i <= j."""
        self.flush()
        i, j, place = np.nonzero(self.sums)
        return i, j, place, self.sums[i, j, place]


def scatter(df: DataFrame, vector: str, bounds: Bounds) -> np.ndarray:
    """n * sum of products - product of sums for each pair of dimensions, as Python integers."""
    size = len(bounds.sums)

    def work(batches):
        slices = Slices(bounds)
        for batch in batches:
            slices.add(integers(batch.column(0), size)[1])
        i, j, place, piece = slices.products()
        yield [pa.array(c, t) for c, t in ((i, pa.int32()), (j, pa.int32()), (place, pa.int32()), (piece, pa.int64()))]

    parts = map_batches(df.select(vector), work, "i int, j int, place int, piece long")
    added = parts.groupBy("i", "j", "place").agg(F.sum("piece").alias("piece")).toArrow().to_pydict()
    products = np.zeros((size, size), object)
    for i, j, place, piece in zip(added["i"], added["j"], added["place"], added["piece"]):
        products[i, j] += piece << (32 * place)
    sums = [s - bounds.n * a for s, a in zip(bounds.sums, bounds.least)]  # of the shifted integers
    out = np.zeros((size, size), object)
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = bounds.n * products[i, j] - sums[i] * sums[j]
    return out


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The components of all usable vectors; None if there is none."""
    bounds = bounds_of(df, vector)
    if bounds is None:
        return None
    centred = scatter(df, vector, bounds)
    covariance = np.array([[value / bounds.n**2 for value in row] for row in centred], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    heaviest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return Whitening(bounds, values, vectors * np.where(heaviest < 0, -1.0, 1.0), float(np.trace(covariance)))


def deviations(centred: np.ndarray, largest: int) -> np.ndarray | list[int]:
    """Sums of squares, exactly; ``largest`` bounds the size of the entries."""
    if largest**2 * max(1, centred.shape[1]) < 1 << 63:
        return np.einsum("ij,ij->i", centred, centred)
    return [sum(v * v for v in row) for row in centred.tolist()]


def project(df: DataFrame, model: Whitening, components: int, id: str, vector: str) -> DataFrame:
    """One row a vector: id, deviation decimal(38, 0), whitened array<double>."""
    bounds, size = model.bounds, len(model.bounds.sums)
    n, sums = bounds.n, bounds.sums
    largest = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, bounds.least, bounds.greatest))
    kind = np.int64 if largest < 1 << 62 and n * (max(map(abs, (*bounds.least, *bounds.greatest))) + 1) < 1 << 62 else object
    values, vectors = model.values[:components], model.vectors[:components]
    varies = values > TINY * max(values[0], 0.0)

    def work(batches):
        offsets = np.array(sums, kind)
        for batch in batches:
            places, x = integers(batch.column(1), size)
            centred = x.astype(kind) * n - offsets
            scores = (centred / n).astype(float) @ vectors.T
            whitened = scores / np.sqrt(np.where(varies, values, 1.0))
            lists = [[v if ok else None for v, ok in zip(row, varies)] for row in whitened.tolist()]
            squares = deviations(centred, largest)
            squares = squares if isinstance(squares, list) else squares.tolist()
            squares = [s if s < 10**38 else None for s in squares]
            yield [batch.column(0).take(pa.array(places)), pa.array(squares, pa.decimal128(38, 0)), lists]

    kinds = dict(df.dtypes)
    return map_batches(df.select(id, vector), work, f"`{id}` {kinds[id]}, deviation decimal(38,0), whitened array<double>")


def whiten(df: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component from 1, n, deviation, whitened, explained, identity_error for each usable vector and component.

    ``deviation`` is exact, and null only where it has more than 38 digits.
    The whitened rows are written once; their covariance is measured on them.
    """
    kind = dict(df.dtypes)[id]
    model = fit(df, vector)
    if model is None:
        layout = f"`{id}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], layout)
    rows = materialise(project(df, model, components, id, vector), "whitened")
    values = model.values[:components]
    used = np.flatnonzero(values > TINY * max(values[0], 0.0)).tolist()
    pairs = [(i, j) for i in used for j in used if i <= j]
    measured = rows.agg(F.lit(0).alias("_"), *[F.covar_pop(rows["whitened"][i], rows["whitened"][j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    error = max((abs(measured[f"{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)
    shares = [float(v) / model.trace if model.trace else 0.0 for v in values]
    return rows.select(id, "deviation", F.posexplode("whitened").alias("_place", "whitened")).select(
        id,
        (F.col("_place") + 1).alias("component"),
        F.lit(model.bounds.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares))[F.col("_place")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
