"""Redaction where the frames lie: the same pixels as by a join, and no exchange of them."""

import numpy as np
from pyspark.sql import functions as F

from trackwell.functions import pixels
from trackwell.operators import redaction

TARGETS = "video string, frame_index long, ord int, style string, x1 double, y1 double, x2 double, y2 double"
STYLES = ("pixelate", "black-box", "eye-bar", "eye-bar-fine")


def _frames(spark):
    rng = np.random.default_rng(1)
    rows = []
    for video, n in (("a", 25), ("b", 7), (None, 2)):
        for k in range(n):
            w, h = (40, 32) if k % 2 else (24, 30)
            rows.append((video, k, w, h, bytearray(rng.integers(0, 256, w * h * 4, dtype=np.uint8).tobytes())))
    return spark.createDataFrame(rows, "video string, frame_index long, width int, height int, rgba binary")


def _targets(spark):
    rng = np.random.default_rng(2)
    rows = [(v, int(k), o, STYLES[rng.integers(4)], *map(float, np.sort(rng.integers(-5, 50, 4))[[0, 1, 2, 3]])) for v in ("a", "b") for k in rng.integers(0, 30, 20) for o in range(2)]
    return spark.createDataFrame([*rows, ("a", 3, 0, "black-box", 0.0, 0.0, 1.0, 9.0), ("none", 1, 0, "pixelate", 0.0, 0.0, 9.0, 9.0)], TARGETS)


def test_in_place_equals_the_join_and_moves_no_pixels(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames, targets = _frames(spark), _targets(spark)
        spark.sql("DROP TABLE IF EXISTS frames_laid_out")
        laid = redaction.lay_out(frames, "frames_laid_out", "video", 8, span=5)
        drawn = redaction.redact_in_place(laid, targets, "video", span=5)
        plan = drawn._jdf.queryExecution().executedPlan()
        lines = plan.toString().split("\n")
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "rgba" in x)
        depth = lines[scan].index("FileScan")
        above = [x for i, x in enumerate(lines[:scan]) if len(x) - len(x.lstrip(" :+-*()0123456789")) < depth and ("Exchange" in x or "Sort" in x)]
        # Exchanges stand on the side of the targets alone: after the scan, or none above it.
        assert not above and any("Exchange" in x for x in lines[scan + 1 :]) and "Bucketed: true" in lines[scan]
        got = {(r.video, r.frame_index): bytes(r.rgba) for r in drawn.collect()}
        want = {(r.video, r.frame_index): bytes(r.rgba) for r in redaction.redact_frames(frames, targets, ["video", "frame_index"]).collect()}
        assert drawn.columns == laid.columns and got == want and len(got) == 34
        same = {(r.video, r.frame_index): bytes(r.rgba) for r in frames.collect()}
        assert sum(got[k] != same[k] for k in got) > 10
    finally:
        spark.sql("DROP TABLE IF EXISTS frames_laid_out")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mosaic_against_block_means():
    image = np.random.default_rng(3).integers(0, 256, (50, 61, 4), dtype=np.uint8)
    got = pixels.redacted(image, "pixelate", 3, 4, 40, 37, block=15)
    want = image.copy()
    for top in range(4, 41, 15):
        for left in range(3, 43, 15):
            part = image[top : min(top + 15, 41), left : min(left + 15, 43), :3]
            want[top : min(top + 15, 41), left : min(left + 15, 43), :3] = part.reshape(-1, 3).astype(int).sum(axis=0) // (part.shape[0] * part.shape[1])
    assert (got == want).all()
    assert (pixels.redacted(image, "pixelate", 70, 4, 5, 5) == image).all()
