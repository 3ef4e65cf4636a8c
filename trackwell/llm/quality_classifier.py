"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch, free_name

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id; all are used below that.
MAX_LABELLED = 200_000
#: One in so many of them calibrates instead of fitting.
CALIBRATION = 4
#: Tasks that sum normal equations; each sends the driver one matrix of FOURIER + 1 squared.
TASKS = 16
FOURIER = 255
RIDGE = 1e-2
SEED = 11

_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>", b".", b",;:", b"!?", b"-_/\\@=+~^`{}[]", b"()\"'",
)
_TABLE = np.full(256, len(_CLASSES), dtype=np.int64)
for _n, _chars in enumerate(_CLASSES):
    _TABLE[list(_chars)] = _n
_TABLE[128:] = len(_CLASSES) + 1
N_STATISTICS = 12 + len(_CLASSES) + 2


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text's form; nothing but the text goes in."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    classes = np.bincount(_TABLE[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 2) / size
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    full = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(set(words)) / max(1, n),
        len(set(lines)) / max(1, len(lines)), full / max(1, len(lines)), np.log1p(n / max(1, len(lines))), np.log1p(len(lines)),
        sum(len(w) == 1 for w in words) / max(1, n), sum(w[:1].isupper() for w in words) / max(1, n), float(n == 0), *np.sqrt(classes),
    ]


def _statistics_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([statistics(t.as_py()) for t in batch], pa.list_(pa.float64()))

    return compute(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    base: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(w x + b): inner products of these approximate a Gaussian kernel of standardized statistics."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        if self.steps is None:
            return np.clip(self.raw(x), 0, 1)
        # The blocks' slope leaves ties where calibration is flat; a trace of the raw score parts them.
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: centres and means of the blocks of the best non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + c]
    return np.array([c / n for _, n, c in blocks]), np.array([s / n for s, n, _ in blocks])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATISTICS)


def fit(rows: DataFrame, seed: int = SEED, max_labelled: int = MAX_LABELLED) -> Model:
    """rows(x array<double>, y 0/1, h long: an even hash) -> a calibrated model.

    Above max_labelled rows, those with the lowest hashes are used, in proportion. Each of
    TASKS tasks sums the normal equations of its rows; only those sums, and the raw scores of
    the calibration rows, reach the driver. Without rows, or with one class, every score is
    the share of label 1 (0.5 without rows).
    """
    n, ones, *moments = rows.agg(
        F.count("*"), F.coalesce(F.sum("y"), F.lit(0)),
        *[f(F.get("x", F.lit(i))) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)],
    ).first()
    rng = np.random.default_rng(seed)
    fill = lambda v, default: np.array([default if a is None else a for a in v])
    scale = fill(moments[1::2], 1.0)
    directions = rng.normal(size=(N_STATISTICS, FOURIER)) / np.sqrt(N_STATISTICS)
    model = Model(fill(moments[::2], 0.0), np.where(scale > 1e-9, scale, 1.0), directions, rng.uniform(0, 2 * np.pi, FOURIER))
    model.base = ones / n if n else 0.5
    if ones in (0, n):
        return model
    share = min(1.0, max_labelled / n)
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).repartition(TASKS, "h")
    calibrates = F.pmod(F.shiftright("h", 20), F.lit(CALIBRATION)) == 0

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1)
        for batch in batches:
            z = model.features(_matrix(batch, "x"))
            a += z.T @ z
            b += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, b]).ravel()], pa.list_(pa.float64()))], ["sums"])

    total = np.zeros((FOURIER + 2, FOURIER + 1))
    for row in rows.where(~calibrates).select("x", "y").mapInArrow(normal_equations, "sums array<double>").toLocalIterator():
        total += np.array(row["sums"]).reshape(total.shape)
    a, b = total[:-1], total[-1]
    model.weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch, "x"))), batch.column("y").cast(pa.float64())], ["raw", "y"])

    held = rows.where(calibrates).select("x", "y").mapInArrow(raw, "raw double, y double").toPandas()
    if len(held) and 0 < held["y"].sum() < len(held):
        model.steps = isotonic(held["raw"].to_numpy(), held["y"].to_numpy())
    return model


def score(docs: DataFrame, labelled: DataFrame, learn: Column, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, score (double, 0 to 1, higher: label 1 likelier).

    labelled(doc_id, quality): labels of rows of docs where `learn`, a condition on doc_id,
    holds are learned; null labels and ids are left out, and a document with several labels
    counts with each. Only the text goes into a score. Null text is like empty text. An empty
    table gives an empty result. Texts are read once: their statistics, some twenty numbers a
    row, are written to the shared scratch folder.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    facts = scratch.save(docs.select("doc_id", _statistics_of(F.col("text")).alias("x")))
    known = labelled.where("quality is not null and doc_id is not null").where(learn).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = facts.join(known, "doc_id").select("x", "y", F.xxhash64(F.lit(SEED), "doc_id").alias("h"))
    model = fit(scratch.save(rows))

    @F.arrow_udf("double")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), N_STATISTICS)
            yield pa.array(model.score(x) if len(x) else np.empty(0))

    return facts.select("doc_id", apply("x").alias(free_name(facts, "score")))
