"""Whitening against exact fractions: slices, digits, odd vectors, and values far from zero."""

import math
from fractions import Fraction

import numpy as np
import pytest

from trackwell.llm import queries, whitening


def _plain(vectors):
    """Exact x, n, sums and covariance (fractions) of (id, vector) rows."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = [[Fraction(sum(y[i] * y[j] for y in centred), n**3) for j in range(d)] for i in range(d)]
    return kept, n, sums, cov


def _check(rows, vectors, most=16):
    kept, n, sums, cov = _plain(vectors)
    d = len(sums)
    v = np.array([[float(c) for c in r] for r in cov])
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = sum(values[:most] > d * np.finfo(float).eps * values[0])
    assert len(rows) == k * len(kept)
    by: dict = {}
    for r in rows:
        by.setdefault((r.vec_id, r.deviation_digits), []).append(r)
    for i, x in kept:
        y = [n * c - s for c, s in zip(x, sums)]
        own = by[i, str(sum(c * c for c in y))]
        assert {r.component for r in own} == set(range(1, k + 1)) and {r.n for r in own} == {n}
        assert all(r.deviation == (int(r.deviation_digits) if int(r.deviation_digits) < 1 << 63 else None) for r in own)
        length = sum(r.whitened**2 * values[r.component - 1] for r in {r.component: r for r in own}.values())
        if k == d:  # all components together keep the length
            assert length == pytest.approx(sum((c / n) ** 2 for c in y), rel=1e-6)
    assert max(abs(r.explained * float(sum(cov[j][j] for j in range(d))) / values[r.component - 1] - 1) for r in rows) < 1e-9
    assert max(r.identity_error for r in rows) < 1e-6 and len({r.identity_error for r in rows}) == 1


def test_slices_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    total = sum(s.astype(np.int64).astype(object) * 2 ** (whitening.SLICE_BITS * k) for k, s in enumerate(whitening.slices(x)))
    assert (total == x.astype(object)).all()
    assert (whitening.gram(x) == x.astype(object).T @ x.astype(object)).all()
    values = [0, -1, 5, -(1 << 190), (1 << 190) + 7]
    assert [sum(d[i] << whitening.DIGIT_BITS * k for k, d in enumerate(whitening._digits(values))) for i in range(5)] == values


@pytest.mark.parametrize("shift", [0.0, 1e4, -3e9])
def test_whitened_against_fractions(spark, shift):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + shift
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(0, [float(c) for c in base[0]]), (None, [float(c) for c in base[1]])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in vectors + odd], "vec_id int, embedding array<double>, n string")
    _check(whitening.whiten(frame).collect(), vectors)
    few = whitening.whiten(frame, most=2)
    assert {r.component for r in few.collect()} == {1, 2}


def test_projections_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 6)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    x = np.floor(64 * v.astype(np.float64))
    y = x - np.unique(x, axis=0).mean(axis=0)
    cov = y.T @ y / len(y)
    values, axes = np.linalg.eigh(cov)
    for r in whitening.whiten(frame).collect():
        want = y[r.vec_id] @ axes[:, -r.component] / np.sqrt(values[-r.component])
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)


def test_no_variance_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], kind)).collect()
    assert {r.component for r in line} == {1} and len(line) == 4 and line[0].explained == pytest.approx(1)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 2 and all(r.deviation is None and int(r.deviation_digits) > 1 << 63 for r in huge)


def test_query_against_fractions(spark, sf_dir):
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    _check(queries.op12_whitening(spark, sf_dir).collect(), vectors)
