"""The filter by blocks equals the filter row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.operators import long_tracks, tracking


def _rows(frame):
    return {(r.obj, r.frame_index): (r.x, r.v, r.p, r.q) for r in frame.collect()}


@pytest.mark.parametrize("span", [1, 7, 50, 4096])
def test_blocks_change_nothing(spark, span):
    """Tracks that begin late, in the middle of a block or never, with gaps of frames and of values."""
    rng = np.random.default_rng(1)
    rows = []
    for obj, (n, first, seen) in enumerate([(120, 0, 0.5), (90, 33, 0.2), (60, 61, 0.9), (1, 0, 1.0), (70, 14, 1.0), (200, 5, 0.02)]):
        for f in sorted(rng.choice(3 * n, n, replace=False)):
            known = f >= first and rng.random() < seen
            rows.append((obj, int(f), float(f * 0.7 + rng.normal()) if known else float("nan") if rng.random() < 0.5 else None))
    frame = spark.createDataFrame(rows, "obj int, frame_index long, z double")
    got, want = _rows(long_tracks.smooth_long(frame, ["obj"], "z", span)), _rows(tracking.smooth(frame, ["obj"], "z"))
    assert got.keys() == want.keys() and len(got) > 200
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-7) for k in got for a, b in [(got[k], want[k])])
    assert long_tracks.smooth_long(frame.where("false"), ["obj"], "z").collect() == []


def test_a_long_track_is_spread_over_tasks(spark):
    """200,000 frames of one track: no group of values is larger than a block, and the last frames equal those of the plain filter."""
    n = 200_000
    frames = spark.range(n).select(F.lit(1).alias("obj"), F.col("id").alias("frame_index"), F.when(F.col("id") % 3 == 0, F.sin(F.col("id") / 50) * 100).alias("z"))
    got = long_tracks.smooth_long(frames, ["obj"], "z", 1000).where(F.col("frame_index") >= n - 50)
    axis, want = None, {}
    for f in range(n):
        z = float(np.sin(f / 50) * 100) if f % 3 == 0 else None
        if axis is None:
            axis = tracking.Axis(z)
        else:
            axis.predict()
            if z is not None:
                axis.update(z)
        if f >= n - 50:
            want[1, f] = (axis.x, axis.v, axis.p, axis.q)
    got = _rows(got)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-6) for k in got)


def test_no_grid_grows_with_the_batch(spark, monkeypatch):
    """A batch of many blocks is filtered a few at a time."""
    import pyarrow as pa

    monkeypatch.setattr(long_tracks, "CELLS", 100)
    batch = pa.RecordBatch.from_pydict({"z": pa.array([[float(n)] * (n % 31) for n in range(200)], pa.list_(pa.float64()))})
    parts = list(long_tracks._slices(iter([batch])))
    assert max(long_tracks._columns(p)[0].size for p in parts) <= 100 and [z for p in parts for z in p.to_pydict()["z"]] == batch.to_pydict()["z"]


def test_a_track_passes_through_a_task_by_batches(spark):
    """Tracks longer than Arrow's batches, side by side in one task: the state goes on over batches and not over tracks; no task gets a group whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(obj, f, float(f * (obj or 3)) if f % 3 == 0 and f >= 7 else None) for obj in (1, 2, None) for f in range(180)]
        made = tracking.smooth(spark.createDataFrame(rows, "obj int, frame_index long, z double").repartition(3), ["obj"], "z")
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
        got = _rows(made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for obj in (1, 2, None):
        axis = tracking.Axis(9.0 * (obj or 3))
        for f in range(10, 180):
            axis.predict()
            if f % 3 == 0:
                axis.update(float(f * (obj or 3)))
            assert got[obj, f] == (axis.x, axis.v, axis.p, axis.q)
    assert len(got) == 3 * 171 and tracking.smooth(spark.createDataFrame([], "obj int, frame_index long, z double"), ["obj"], "z").collect() == []
