"""Rounds of local choices equal the greedy ones, also where groups are large and boxes odd."""

import numpy as np
from pyspark.sql import functions as F

from trackwell.operators import detection, matching, rounds

BOXES = "frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double"


def _boxes(n, frames, side, seed):
    rng = np.random.default_rng(seed)
    xy, wh = rng.random((n, 2)) * side, rng.random((n, 2)) * 40
    conf = rng.integers(0, 20, n) / 20  # many ties
    return [(int(i % frames), i, *map(float, xy[i]), *map(float, xy[i] + wh[i]), float(conf[i])) for i in range(n)]


def _rows(frame):
    return sorted(map(tuple, frame.select("frame", "det_id", "confidence").collect()), key=repr)


def test_suppression_in_rounds(spark):
    odd = [(0, 9000, 100.0, 100.0, 100.0, 100.0, 0.9), (0, 9001, 100.4, 100.4, 100.4, 100.4, 0.8), (0, 9002, 127.9, 50.0, 127.9, 50.0, 0.5), (0, 9003, 128.1, 50.0, 128.1, 50.0, 0.5),
           (1, 9004, None, 1.0, 2.0, 2.0, 0.5), (1, 9005, 1.0, 1.0, 9.0, 9.0, 0.5), (1, 9006, 1.0, 1.0, 9.0, 9.0, 0.5)]
    boxes = spark.createDataFrame(_boxes(1500, 3, 300, 1) + odd, BOXES)
    got = rounds.suppress_crowded(boxes, ["frame"], 0.35, cell=64)
    assert _rows(got) == _rows(detection.suppress(boxes, ["frame"], 0.35))
    assert got.columns == detection.suppress(boxes, ["frame"], 0.35).columns
    assert rounds.suppress_crowded(boxes.where("false"), ["frame"], 0.35).collect() == []


def test_a_crowded_frame(spark):
    """20,000 boxes of one frame against a plain loop over a grid."""
    rows = _boxes(20_000, 1, 2500, 2)
    got = {r.det_id for r in rounds.suppress_crowded(spark.createDataFrame(rows, BOXES), ["frame"], 0.35).collect()}
    kept, cells = set(), {}
    for _, i, x1, y1, x2, y2, c in sorted(rows, key=lambda r: (-r[6], r[1])):
        near = [b for gx in range(int(x1 // 50) - 1, int(x2 // 50) + 2) for gy in range(int(y1 // 50) - 1, int(y2 // 50) + 2) for b in cells.get((gx, gy), ())]
        def over(b):
            w, h = max(0, min(x2, b[2]) - max(x1, b[0]) + 1), max(0, min(y2, b[3]) - max(y1, b[1]) + 1)
            return w * h / ((x2 - x1 + 1) * (y2 - y1 + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - w * h)
        if not any(over(b) > 0.35 for b in near):
            kept.add(i)
            cells.setdefault((int(x1 // 50), int(y1 // 50)), []).append((x1, y1, x2, y2))
    assert got == kept


def test_greedy_in_rounds(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(g), int(a), int(b)) for g, a, b in rng.integers(0, [3, 60, 60], (2500, 3))})
    pairs = spark.createDataFrame([(*r, float(rng.integers(0, 12) / 12)) for r in rows], "g long, a long, b long, s double")
    got, want = rounds.greedy_crowded(pairs, ["g"], "a", "b", "s"), matching.greedy(pairs, ["g"], "a", "b", "s")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rounds.greedy_crowded(pairs.where("false"), ["g"], "a", "b", "s").collect() == []
    null = pairs.withColumn("a", F.when(F.col("a") > 30, F.col("a")))
    assert rounds.greedy_crowded(null, ["g"], "a", "b", "s").where("a is null").collect() == []
