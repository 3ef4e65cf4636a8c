import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackwell.functions import geometry, naming, vectors
from trackwell.operators import matching, redaction, selection, tracking
from trackwell.plans.views import view
from trackwell.streaming.tracker import track_stream


def _box(*c):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(geometry.CORNERS, c)])


def test_both_overlaps(spark):
    a, b, c = _box(0, 0, 10, 10), _box(5, 0, 15, 10), _box(10, 0, 20, 10)
    row = spark.range(1).select(geometry.iou(a, b), geometry.pixel_iou(a, b), geometry.iou(a, c), geometry.pixel_iou(a, c)).first()
    assert list(row) == pytest.approx([1 / 3, 0.375, 0, 0.047619], abs=1e-6)


def test_rounding_and_clamping(spark):
    row = spark.range(1).select(
        geometry.half_up(F.lit(-2.5)), geometry.half_up(F.lit(2.5)), geometry.clamp(F.lit(float("nan")), 0.0, 1.0), geometry.clamp(F.lit(7.0), 0.0, 1.0)
    ).first()
    assert (row[0], row[1], row[3]) == (-2, 3, 1) and row[2] != row[2]


def test_zero_vector_stays(spark):
    assert spark.range(1).select(vectors.normalized(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_names(spark):
    made = spark.createDataFrame([("a.b.mov",), ("noext",), (None,)], "n string").select(naming.output_name(F.col("n"))).collect()
    assert [r[0] for r in made] == ["a.b_blurred.mp4", "noext", "video_blurred.mp4"]
    assert [r[0] for r in spark.createDataFrame([(1,), (12345,)], "i int").select(naming.frame_name(F.col("i"))).collect()] == ["frame_0001.jpg", "frame_12345.jpg"]


def test_greedy_is_one_to_one(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 0.6), (0, 1, 0, 0.5), (0, 1, 1, 0.4)], "g int, d long, t long, s double")
    assert sorted((r.d, r.t) for r in matching.greedy(pairs, ["g"], "d", "t", "s").collect()) == [(0, 0), (1, 1)]


def test_assignment_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        cost = [[rng.randint(0, 20) for _ in range(m)] for _ in range(n)]
        pairs = matching.assign(cost)
        assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len(pairs) == len({c for _, c in pairs})
        if n <= m:
            best = min(sum(cost[r][c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert sum(cost[r][c] for r, c in pairs) == best
    with pytest.raises(ValueError):
        matching.assign([[float("nan")]])


def test_filter_follows_the_worked_example():
    axis = tracking.Axis(0.0)
    seen = []
    for z in (None, 2.0, None, 5.0, None):
        axis.predict()
        if z is not None:
            axis.update(z)
        seen.append((axis.x, axis.v, axis.p, axis.q))
    assert seen[1] == pytest.approx((1.990566, 0.490566, 1.990566, 78.490566), abs=1e-5)
    assert seen[4] == pytest.approx((5.985362, 0.997656, 129.722547, 63.867335), abs=1e-5)


def test_track_expires():
    tracker = tracking.Tracker(scan=[(3, (0, 0, 50, 50))])
    alive = [f for f in range(30) if tracker.step(f, [(0, 0, 50, 50)] if f == 4 else [])]
    assert alive == list(range(4, 22))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    obs = view(spark, sf_dir, "obs").withColumn("video_id", F.floor(F.col("frame_index") / 50))
    scan = obs.where("frame_index % 30 = 0").select("video_id", F.col("obj_id").alias("cluster_id"), F.col("det_id").alias("ord"), *geometry.CORNERS)
    dets = obs.where("observed").select("video_id", "det_id", "frame_index", *geometry.CORNERS)
    ends = dets.groupBy("video_id").agg(F.lit(-1).cast("long").alias("det_id"), F.max("frame_index").alias("frame_index"), *[F.lit(0.0).alias(c) for c in geometry.CORNERS])
    for n, part in enumerate([dets.where("frame_index % 50 < 17"), dets.where("frame_index % 50 >= 17"), ends]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in/*")
        track_stream(stream, scan).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(tuple(round(v, 6) for v in r) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(tracking.track(dets, scan))


def test_nan_similarity_never_matches(spark):
    items = spark.createDataFrame([(1, [float("nan"), 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    known = spark.createDataFrame([(7, [1.0, 0.0])], "id long, embedding array<double>")
    assert [(r.vec_id, r.id) for r in matching.best_by_cosine(items, known, 0.5).collect()] == [(2, 7)]


def test_mebibytes_round_halves_to_even(spark):
    sizes = [0, 1, 52_429, 1 << 18, 3 << 18, 5 << 18, (1 << 20) * 12_345 + (1 << 18), (1 << 52) + (1 << 18), 7919 * 262_144]
    made = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", naming.mebibytes(F.col("s")).alias("m"), naming.mebibytes(F.col("s"), 0).alias("w")).collect()
    assert [(r.m, r.w) for r in made] == [(f"{s / 2**20:.1f}", f"{s / 2**20:.0f}") for s in sizes]


def test_progress(spark):
    p = spark.createDataFrame([("detecting-faces", 40.0), ("processing-frames", 10.0)], "phase string, phase_percent double")
    assert [r.overall_percent for r in selection.overall_percent(p).collect()] == [35.0, 80.0]


def test_pixels_are_block_means():
    import numpy as np

    frame = np.arange(20 * 20 * 4, dtype=np.uint8).reshape(20, 20, 4)
    out = redaction.redact_pixels(frame, "pixelate", 2, 2, 15, 15)
    assert (out[2:17, 2:17, 0] == int(frame[2:17, 2:17, 0].mean())).all() and (out[0] == frame[0]).all()
    assert (redaction.redact_pixels(frame, "black-box", 0, 0, 5, 5)[:5, :5, :3] == 0).all()
