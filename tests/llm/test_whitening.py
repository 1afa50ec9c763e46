"""Whitening against exact arithmetic in plain Python."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from rankloom.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, whitened double, dim int, x string"


def usable(vectors):
    full = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(map(len, full), default=0)
    return [v for v in full if size and len(v) == size]


def brute(vectors):
    """(x, n, sums, covariance as fractions)"""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in usable(vectors)]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    size = len(sums)
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(size)] for i in range(size)]
    return x, n, sums, cov


def check(rows, vectors, components=whitening.COMPONENTS):
    x, n, sums, cov = brute(vectors)
    size = min(components, len(sums))
    assert len(rows) == n * size
    exact = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(exact)[::-1][:size]
    scores = np.empty((n, size))
    for at in range(0, len(rows), size):
        some = rows[at : at + size]
        assert [r["component"] for r in some] == list(range(1, size + 1))
        assert {r["n"] for r in some} == {n}
        assert {r["deviation"] for r in some} == {sum((n * c - s) ** 2 for c, s in zip(x[at // size], sums))}
        assert [r["explained"] for r in some] == pytest.approx((values / np.trace(exact)).tolist(), rel=1e-9, abs=1e-12)
        scores[at // size] = [np.nan if r["whitened"] is None else r["whitened"] for r in some]
    assert np.allclose(np.isnan(scores).all(axis=0), values <= whitening.TINY * values[0])
    # Scores times the root of the eigenvalue are the projections: their products give the rows back.
    centred = np.array([[Fraction(n * c - s, n) for c, s in zip(row, sums)] for row in x], float)
    used = ~np.isnan(scores).any(axis=0)
    loads = centred.T @ scores[:, used] / n / np.sqrt(values[used])  # the eigenvectors, were they not known
    assert np.allclose(exact @ loads, loads * values[used], atol=1e-7 * values[0])
    assert np.allclose(loads.T @ loads, np.eye(used.sum()), atol=1e-6)
    z = scores[:, used] - scores[:, used].mean(axis=0)
    error = np.abs(z.T @ z / n - np.eye(used.sum())).max(initial=0)
    assert {round(r["identity_error"], 9) for r in rows} == {round(error, 9)} and error <= 1e-4


def table(spark, vectors):
    rows = [(k, v, 1, 2, 3, 0.5, 4, "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def whitened(df, **more):
    rows = whitening.whiten(df, **more).collect()
    return sorted(rows, key=lambda r: (-1 if r["vec_id"] is None else r["vec_id"], r["component"]))


def test_query_against_exact_arithmetic(spark):
    found = queries.QUERIES["op11_bit_sliced_whitening"](spark, SF_DIR)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    rows = sorted(found.collect(), key=lambda r: (r["vec_id"], r["component"]))
    vectors = [r["embedding"] for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()]
    check(rows, vectors)


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors_of_mixed_ranges(spark, seed):
    rng = np.random.default_rng(seed)
    scale = 10.0 ** rng.integers(-1, 3, 6)
    vectors = (rng.normal(size=(70 + seed, 6)) * scale).tolist()
    check(whitened(table(spark, vectors).repartition(5)), vectors)


def test_slices_count_like_plain_products():
    rng = np.random.default_rng(4)
    x = rng.integers(-(10**9), 10**9, (3 * 64 + 5, 4)) >> np.array([0, 7, 20, 29])
    bounds = whitening.Bounds(len(x), (), tuple(x.min(axis=0).tolist()), tuple(x.max(axis=0).tolist()))
    slices = whitening.Slices(bounds)
    for part in np.array_split(x, 7):
        slices.add(part)
    got = np.zeros((4, 4), object)
    for i, j, place, piece in zip(*slices.products()):
        got[i, j] += int(piece) << (32 * int(place))
    shifted = (x - x.min(axis=0)).astype(object)
    assert (got == np.triu(shifted.T @ shifted)).all()


def test_unusable_rows_drop_out(spark):
    good = [[0.1, 0.2, -0.3], [0.4, -0.1, 0.2], [-0.2, 0.3, 0.9], [0.1, 0.2, -0.3]]
    bad = [None, [], [0.1, None, 0.2], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [0.5, 0.5], [3e38, 0.0, 0.0]]
    df = table(spark, [*good, *bad])
    rows = whitened(df)
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3}
    check(rows, good)
    anonymous = df.where("vec_id < 2").unionByName(df.where("vec_id < 2").withColumn("vec_id", df["vec_id"] - df["vec_id"]))
    assert len(whitened(anonymous)) == 4 * 3
    nameless = df.selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding").where("get(embedding, 0) IS NOT NULL")
    assert {r["vec_id"] for r in whitened(nameless)} == {None}


def test_no_variance_and_no_rows(spark):
    (row,) = whitened(table(spark, [[1.0, 2.0]]), components=1)
    assert (row["whitened"], row["explained"], row["identity_error"], row["deviation"]) == (None, 0.0, 0.0, 0)
    constant = [[1.0, float(k), 5.0] for k in range(5)]
    check(whitened(table(spark, constant)), constant)
    for empty in (table(spark, []), table(spark, [None, []])):
        found = whitening.whiten(empty)
        assert found.count() == 0
        assert found.dtypes == whitening.whiten(table(spark, constant)).dtypes


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 2.0], [3.5, 3.0]]
    rows = whitened(table(spark, vectors))
    x, n, sums, _ = brute(vectors)
    assert [int(r["deviation"]) for r in rows[::2]] == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    check(whitened(table(spark, vectors).repartition(3)), vectors)
