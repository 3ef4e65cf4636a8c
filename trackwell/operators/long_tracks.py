"""The constant-velocity filter over tracks of any length: gains from the pattern of observed frames, means as affine maps that are composed by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.operators.tracking import MEASURE_NOISE, POSITION_NOISE, VELOCITY_NOISE, Axis

#: Frames of a block, the unit of parallel work, and frames of all blocks that a task filters side by side.
SPAN, CELLS = 4096, 1 << 18
_START = Axis(0.0)


def _pattern_walk(pieces: Iterator[str], p: float, q: float, begun: bool) -> Iterator[tuple[float, float, bool]]:
    """Before each piece of '0's and '1's, one for each frame: the variances, and whether the track has begun."""
    for piece in pieces:
        yield p, q, begun
        if not begun:
            first = piece.find("1")
            if first < 0:
                continue
            begun, p, q, piece = True, _START.p, _START.q, piece[first + 1 :]
        for seen in piece:
            p, q = p + 2 * q + POSITION_NOISE, q + VELOCITY_NOISE
            if seen == "1":
                total = p + MEASURE_NOISE
                p, q = p * (1 - p / total), q * (1 - q / total)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in batches of about CELLS frames, so that the grids don't grow with Arrow's batches."""
    for batch in batches:
        longest = int(batch.column("z").value_lengths().to_numpy().max(initial=1))
        size = max(1, CELLS // max(1, longest))
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the blocks of a batch as rows of a grid, which of them are seen, and which are frames at all."""
    lists = batch.column("z")
    sizes = lists.value_lengths().to_numpy()
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    z = np.full(inside.shape, np.nan)
    z[inside] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return z, ~np.isnan(z), inside


def _steps(z: np.ndarray, seen: np.ndarray, inside: np.ndarray, p: np.ndarray, q: np.ndarray, begun: np.ndarray):
    """For each place of the blocks, all at once: which rows predict, update and begin there, with gain and pull; p and q change on the way."""
    for k in range(z.shape[1]):
        moves = begun & inside[:, k]
        p[moves] += 2 * q[moves] + POSITION_NOISE
        q[moves] += VELOCITY_NOISE
        updates, begins = moves & seen[:, k], ~begun & seen[:, k]
        total = p + MEASURE_NOISE
        gain, pull = np.where(updates, p / total, 0.0), np.where(updates, q / total, 0.0)
        p *= 1 - gain
        q *= 1 - pull
        p[begins], q[begins] = _START.p, _START.q
        begun |= begins
        yield k, moves, begins, gain, pull


def smooth_long(observations: DataFrame, by: list[str], value: str, span: int = SPAN) -> DataFrame:
    """The result of `tracking.smooth` for tracks of any length, each frame once in its group: (by, frame_index, x, v, p, q) from the first value on.

    Frames are gathered in blocks of `span` ordinals. Variances and gains follow from which frames have a value, so one walk of a track over a bit a
    frame gives the variances at each block's beginning. With its gains, a block maps the mean (x, v) affinely; a second walk over the blocks' maps, six
    numbers each, gives the mean at each beginning, and then every block is filtered by itself. So a task holds the values of some blocks, or
    the bits of one track, never a track's values. NaN counts as no value; rows with a null key are left out; an empty table stays empty.
    """
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema.fields}
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    z = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("frame_index").cast("long").alias("f"), z.alias("z"))))
    blocks = observations.groupBy(*by, F.floor(F.col("frame_index") / span).cast("long").alias("_block")).agg(rows.alias("_rows")).select(
        *by, "_block", F.transform("_rows", lambda r: r["f"]).alias("f"), F.transform("_rows", lambda r: r["z"]).alias("z"),
    )

    def walk_bits(group: pa.Table) -> pa.Table:
        group = group.sort_by("_block")
        p, q, begun = zip(*_pattern_walk(group["bits"].to_pylist(), 0.0, 0.0, False))
        return pa.table([*[group[b] for b in by], group["_block"], pa.array(p, pa.float64()), pa.array(q, pa.float64()), pa.array(begun)], [*by, "_block", "p", "q", "begun"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            z, seen, inside = _columns(batch)
            n = len(z)
            m, c = np.tile(np.eye(2), (n, 1, 1)), np.zeros((n, 2))
            state = [batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("p", "q", "begun")]
            for k, moves, begins, gain, pull in _steps(z, seen, inside, *state):
                m[moves, 0], c[moves, 0] = m[moves, 0] + m[moves, 1], c[moves, 0] + c[moves, 1]
                miss, at = np.where(np.isnan(z[:, k]), 0.0, z[:, k]) - c[:, 0], m[:, 0].copy()
                c += np.stack([gain * miss, pull * miss], axis=1)
                m[:, 0] -= gain[:, None] * at
                m[:, 1] -= pull[:, None] * at
                m[begins], c[begins] = 0.0, np.stack([z[begins, k], np.zeros(begins.sum())], axis=1)
            made = [*m.reshape(n, 4).T, *c.T]
            yield pa.RecordBatch.from_arrays([*[batch.column(b) for b in (*by, "_block", "p", "q", "begun")], *[pa.array(np.ascontiguousarray(x)) for x in made]], [*by, "_block", "p", "q", "begun", *names])

    def walk_maps(group: pa.Table) -> pa.Table:
        group = group.sort_by("_block")
        x, v, at = 0.0, 0.0, []
        for a, b, c, d, e, f in zip(*(group[n].to_pylist() for n in names)):
            at.append((x, v))
            x, v = a * x + b * v + e, c * x + d * v + f
        xs, vs = zip(*at)
        return pa.table([*[group[b] for b in (*by, "_block", "p", "q", "begun")], pa.array(xs, pa.float64()), pa.array(vs, pa.float64())], [*by, "_block", "p", "q", "begun", "x", "v"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            z, seen, inside = _columns(batch)
            x, v, p, q, begun = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("x", "v", "p", "q", "begun"))
            out, known = np.zeros((4, *z.shape)), np.zeros(z.shape, bool)
            for k, moves, begins, gain, pull in _steps(z, seen, inside, p, q, begun):
                x[moves] += v[moves]
                miss = np.where(np.isnan(z[:, k]), 0.0, z[:, k]) - x
                x += gain * miss
                v += pull * miss
                x[begins], v[begins] = z[begins, k], 0.0
                out[:, :, k] = x, v, p, q
                known[:, k] = begun & inside[:, k]
            row = np.nonzero(known)[0]
            frames = batch.column("f").flatten().to_numpy()[known[inside]]
            yield pa.RecordBatch.from_arrays([*[batch.column(b).take(pa.array(row)) for b in by], pa.array(frames), *[pa.array(o[known]) for o in out]], [*by, "frame_index", "x", "v", "p", "q"])

    names = ["xx", "xv", "vx", "vv", "cx", "cv"]
    bits = blocks.select(*by, "_block", F.array_join(F.transform("z", lambda e: F.when(e.isNull(), "0").otherwise("1")), "").alias("bits"))
    starts = bits.groupBy(*by).applyInArrow(walk_bits, f"{keys}, _block long, p double, q double, begun boolean")
    kind = f"{keys}, _block long, p double, q double, begun boolean"
    mapped = blocks.drop("f").join(starts, [*by, "_block"]).mapInArrow(maps, kind + "".join(f", {n} double" for n in names))
    means = mapped.groupBy(*by).applyInArrow(walk_maps, f"{kind}, x double, v double")
    return blocks.join(means, [*by, "_block"]).mapInArrow(apply, f"{keys}, frame_index long, x double, v double, p double, q double")
