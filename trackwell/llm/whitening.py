"""Whitening of embeddings: exact integer second moments from products of digit slices, then eigenvectors of the covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch

#: Bits of a digit slice and vectors of a block: products of two slices, summed over a block, stay under 2^53 and so are exact as doubles.
SLICE_BITS, BLOCK = 16, 16_384
#: Integers travel as digits of so many bits, which Spark adds as longs; together they hold 200 bits.
DIGIT_BITS, DIGITS = 40, 5
#: What an entry is multiplied by before it is floored, what is added then, and the largest absolute value of the floor.
SCALE, SHIFT, MOST = 64.0, 1_000_000, 1 << 61


def integers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have d finite entries, and floor(SCALE * entry) + SHIFT of those."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    values = column.flatten()
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.maximum(sizes, 0)
    bad = np.bincount(np.repeat(np.arange(len(sizes)), held), weights=~(known & np.isfinite(values)), minlength=len(sizes))
    keep = (sizes == d) & (bad == 0)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * values[np.repeat(keep, held)]), -MOST, MOST)
    return keep, x.astype(np.int64).reshape(-1, d) + SHIFT


def slices(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of slices times powers of 2^SLICE_BITS, as doubles; all but the last are from 0 on."""
    out = []
    while True:
        if not len(x) or (-(1 << SLICE_BITS) <= x.min() and x.max() < 1 << SLICE_BITS):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << SLICE_BITS) - 1)).astype(np.float64))
        x = x >> SLICE_BITS


def gram(x: np.ndarray) -> np.ndarray:
    """The exact product of x transposed with x, as big integers."""
    total = np.zeros((x.shape[1],) * 2, dtype=object)
    for start in range(0, len(x), BLOCK):
        parts = slices(x[start : start + BLOCK])
        for p, a in enumerate(parts):
            for q in range(p, len(parts)):
                own = (a.T @ parts[q]).astype(np.int64).astype(object) << SLICE_BITS * (p + q)
                total = total + (own if p == q else own + own.T)
    return total


def _digits(values: list[int]) -> list[list[int]]:
    """Each integer as DIGITS digits, the last one signed."""
    mask, out = (1 << DIGIT_BITS) - 1, []
    for k in range(DIGITS):
        out.append([v >> DIGIT_BITS * k & mask if k < DIGITS - 1 else v >> DIGIT_BITS * k for v in values])
    return out


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the second moments G of the fit list, exact. A last entry of 1 makes n and S part of one product."""
    names = [f"d{k}" for k in range(DIGITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, d)
            total = total + gram(np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(c, pa.int64()) for c in _digits(total[i, j].tolist())]], ["i", "j", *names])

    sums = fit.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} long" for n in names)).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    full = np.zeros((d + 1, d + 1), dtype=object)
    for row in sums.toLocalIterator():
        full[row["i"], row["j"]] = full[row["j"], row["i"]] = sum(row[n] << DIGIT_BITS * k for k, n in enumerate(names))
    return full[d, d], full[d, :d].tolist(), full[:d, :d]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: of 64 bits where that holds it, else big integers."""
    top = int(np.abs(x).max(initial=0))
    if n * top + max(map(abs, sums), default=0) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _deviations(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    top = int(np.abs(y).max()) if y.size else 0
    if y.shape[1] * top * top >= 1 << 63:
        y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def components(n: int, sums: list[int], second: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (as columns), eigenvalues and shares of the trace, by falling eigenvalue; those without variance are left out.

    n * G - S S' is the exact sum of products of the centred vectors, times n; the covariance is rounded once, from there. An
    eigenvector's entry of largest absolute value is positive.
    """
    exact = n * second - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()], np.float64)
    trace = sum(exact.diagonal().tolist()) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(sums) * np.finfo(np.float64).eps * max(float(values.max()), 0.0)]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
    return vectors * signs, values, values / trace if trace else values


_KIND = "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """vectors(vec_id, embedding) -> a row for each vector and component up to `most`: its place on the component in units of standard deviation.

    Vectors that are null or hold null or non-finite entries are left out, and so are those whose size is not the commonest one (the
    greater on ties). Every other vector, repeated ones and null ids too, has its rows; vec_id is cast to long, other columns are not looked
    at. Entries c become x = floor(64 * c) + 1000000, where the floor is held within 2^61. Covariance and components come from
    the distinct x vectors, n in number. A component without variance has no rows: none at all where all vectors are alike, and none of an empty table.
    deviation, the exact sum of squares of n * x - S, is null where it leaves 64 bits; deviation_digits always has it.

    The distinct vectors are written once and read twice. Each task multiplies its own in slices and sends one
    triangle of big integers, in digits that Spark adds; the driver gets one triangle, whose size is that of the dimension, not of the rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sizes = own.where(F.col("embedding").isNotNull() & whole & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("d")).count()
    first = sizes.sort(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], _KIND)
    if first is None:
        return empty
    d = first["d"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column("embedding"), d)
            yield pa.RecordBatch.from_arrays([pa.array(map(bytes, x), pa.binary())], ["x"])

    fit = Scratch(spark, "whiten").save(own.select("embedding").mapInArrow(keys, "x binary").distinct())
    n, sums, second = _moments(fit, d)
    axes, values, shares = components(n, sums, second, most)
    k = len(values)
    if not k:
        return empty
    scaled = axes / np.sqrt(values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, d)
            w = np.concatenate([(_centred(x, n, sums) / n).astype(np.float64) @ scaled, np.ones((len(x), 1))], axis=1)
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    moments = np.zeros((k + 1, k + 1))
    for row in fit.mapInArrow(spread, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        moments[row["i"], row["j"]] = moments[row["j"], row["i"]] = row["s"] / n
    error = float(np.abs(moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column("embedding"), d)
            y = _centred(x, n, sums)
            found = _deviations(y)
            rows = len(found)
            ids = batch.column("vec_id").filter(pa.array(keep))
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(again), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n, np.int64)),
                pa.array([v if v < 1 << 63 else None for v in found], pa.int64()).take(again), pa.array(map(str, found), pa.string()).take(again),
                pa.array(((y / n).astype(np.float64) @ scaled).ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)),
            ], ["vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"])

    return own.mapInArrow(project, _KIND)
