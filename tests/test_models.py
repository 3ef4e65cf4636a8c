"""Model inputs, heads and vectors as rows; the scan job and a frame's composite against plain loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.functions import pixels
from trackwell.operators import models
from trackwell.plans import catalog
from trackwell.plans import scan as scan_job
from trackwell.plans.views import recorded
from trackwell.sources.frames import list_files
from trackwell.sources.y4m import Y4M

FRAMES = "path string, frame_index long, ts_sec double, width int, height int, rgba binary"


def _image(w, h, spots, seed=0):
    image = np.full((h, w, 4), 20, np.uint8)
    image[..., 3] = 255
    for x, y in spots:
        image[y : y + 60, x : x + 60, :3] = np.random.default_rng(seed + x).integers(215, 256, (min(60, h - y), min(60, w - x), 3))
    return image


IMAGES = {("a", 0): _image(640, 480, [(50, 60), (300, 200), (560, 400)]), ("a", 5): _image(640, 480, []), ("b", 0): _image(320, 400, [(10, 20), (200, 300)])}


def _frames(spark):
    rows = [(p, n, n / 10, i.shape[1], i.shape[0], bytearray(i.tobytes())) for (p, n), i in IMAGES.items()]
    return spark.createDataFrame([*rows, ("c", 0, 0.0, 10, 10, None)], FRAMES)


def test_inputs_are_columns(spark):
    out = _frames(spark).select(
        "path", "frame_index", models.rgb().alias("rgb"), models.planes((1, 2, 3), (2, 2, 2), True).alias("planes"), models.letterboxed(64).alias("box"),
        models.cropped(F.lit(5), F.lit(6), F.lit(7), F.lit(8)).alias("cut"), models.cropped(F.lit(5), F.lit(6), F.lit(0), F.lit(8)).alias("none"),
    )
    for r in out.collect():
        if r.path == "c":
            assert r.rgb is None and r.planes is None and r.box is None and r.cut is None
            continue
        image = IMAGES[r.path, r.frame_index]
        rgb = pixels.without_alpha(image)
        assert bytes(r.rgb) == rgb.tobytes() and bytes(r.box) == pixels.letterboxed(image, 64).tobytes() and r.none is None
        assert np.array_equal(np.array(r.planes, np.float32), pixels.planes(rgb, (1, 2, 3), (2, 2, 2), True).ravel())
        assert bytes(r.cut) == pixels.crop(image, 5, 6, 7, 8).tobytes()


def _plain_boxes(image):
    """(det_id, box in the frame, score) by plain loops: heads in order, greedy suppression, shapes, back to the frame."""
    h, w = image.shape[:2]
    heads = catalog.spot_detector()(models.detector_input(image)[None])
    found = []
    for order, stride in enumerate((8, 16, 32)):
        side = 640 // stride
        for cell, (cls, obj, dx, dy, dw, dh) in enumerate(heads[stride][0]):
            score = float(np.sqrt(min(1, max(0, cls)) * min(1, max(0, obj))))
            if score >= 0.3:
                cx, cy, bw, bh = (cell % side + dx) * stride, (cell // side + dy) * stride, np.exp(dw) * stride, np.exp(dh) * stride
                found.append((-score, (order << 32) + cell, [min(640.0, max(0.0, float(v))) for v in (cx - bw / 2, cy - bh / 2, cx + bw / 2, cy + bh / 2)]))
    kept = []
    for s, i, b in sorted(found):
        def over(k):
            x, y = max(0, min(b[2], k[2]) - max(b[0], k[0]) + 1), max(0, min(b[3], k[3]) - max(b[1], k[1]) + 1)
            area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
            return x * y / (area(b) + area(k) - x * y)
        if not any(over(k) > 0.35 for _, _, k in kept):
            kept.append((s, i, b))
    scale = min(640 / w, 640 / h)
    left, top = (640 - int(w * scale + 0.5)) // 2, (640 - int(h * scale + 0.5)) // 2
    out = []
    for s, i, b in kept:
        bw, bh = b[2] - b[0], b[3] - b[1]
        if bw >= 10 and bh >= 10 and bh * 0.4 < bw < bh * 2.5:
            back = [min(float(w), max(0.0, (b[0] - left) / scale)), min(float(h), max(0.0, (b[1] - top) / scale)), min(float(w), max(0.0, (b[2] - left) / scale)), min(float(h), max(0.0, (b[3] - top) / scale))]
            out.append((i, back, -s))
    return out


def test_heads_go_through_the_detector(spark):
    got = {}
    for r in scan_job.detections(_frames(spark), catalog.spot_detector).collect():
        got.setdefault((r.path, r.frame_index), []).append((r.det_id, [r.x1, r.y1, r.x2, r.y2], r.confidence))
    for key, image in IMAGES.items():
        want = _plain_boxes(image)
        own = sorted(got.get(key, []))
        assert [i for i, _, _ in own] == [i for i, _, _ in sorted(want)] and (want or key == ("a", 5))
        for a, b in zip(own, sorted(want)):
            assert a[1] == pytest.approx(b[1], abs=1e-6) and a[2] == pytest.approx(b[2], abs=1e-9)


def test_faces_to_vectors(spark):
    frames = _frames(spark)
    boxes = scan_job.detections(frames, catalog.spot_detector)
    tiny = boxes.limit(1).withColumns({"x1": F.lit(0.0), "x2": F.lit(3.0), "det_id": F.lit(-5).cast("long")})
    out = scan_job.with_vectors(frames, boxes.unionByName(tiny), catalog.spot_recogniser).collect()
    model = catalog.spot_recogniser()
    assert len(out) > 3 and [r.embedding for r in out if r.det_id == -5] == [None]
    for r in out:
        if r.det_id != -5:
            v = model(pixels.face_input(IMAGES[r.path, r.frame_index], r.x1, r.y1, r.x2, r.y2)[None])[0]
            assert r.embedding == pytest.approx((v / np.sqrt((v * v).sum())).tolist(), abs=1e-9)


def test_composite_redacts_only_the_chosen(spark):
    frames = _frames(spark)
    faces = scan_job.with_vectors(frames, scan_job.detections(frames, catalog.spot_detector), catalog.spot_recogniser).where("path = 'a'").sort("x1").collect()
    people = spark.createDataFrame([(1, faces[0].embedding), (2, [-v for v in faces[0].embedding])], "cluster_id int, embedding array<double>")
    same = {(r.path, r.frame_index): r.rgba for r in frames.collect()}
    drawn = {(r.path, r.frame_index): r.rgba for r in scan_job.composite(frames, catalog.spot_detector, catalog.spot_recogniser, people, spark.createDataFrame([(1, "black-box")], "cluster_id int, style string"), threshold=0.999).collect()}
    assert drawn.keys() == same.keys() and drawn["a", 0] != same["a", 0] and drawn["a", 5] == same["a", 5] and drawn["c", 0] is None
    nobody = scan_job.composite(frames, catalog.spot_detector, catalog.spot_recogniser, people, spark.createDataFrame([(2,)], "cluster_id int"), threshold=0.999).collect()
    assert {(r.path, r.frame_index): r.rgba for r in nobody} == same


def test_scan_query_against_plain_loops(spark, sf_dir):
    paths = [p for p, _ in list_files(recorded(spark, sf_dir, spots=True), "*.y4m")]
    want = {}
    for path in paths:
        video, decoder, people = int(os.path.basename(path)[:-4]), Y4M(), {}
        with open(path.removeprefix("file://"), "rb") as file:
            length = decoder.duration(file)
            frames = {n: (w, h, data) for n, _, w, h, data in decoder.frames(file, 0.0)}
        times = [k * 20 + 0.1 for k in range(100) if k * 20 + 0.1 < length - 0.1]
        for n in sorted({min(len(frames) - 1, int((t + 1e-6) * 30)) for t in times}):
            w, h, data = frames[n]
            image = np.frombuffer(data, np.uint8).reshape(h, w, 4)
            large = [b for b in _plain_boxes(image) if b[1][2] - b[1][0] >= 10 and b[1][3] - b[1][1] >= 10]
            for place, (i, box, score) in enumerate(sorted(large, key=lambda b: (b[1][0], b[0]))):
                people.setdefault(place, []).append((-score, n, i))
        for place, own in people.items():
            want[video, place] = (len(own), *min(own)[1:], round(-min(own)[0], 6))
    got = {(r.video, r.cluster_id): (r.face_count, r.frame_index, r.det_id, r.best_confidence) for r in catalog.QUERIES["scan_recorded"](spark, sf_dir).collect()}
    assert got == want


def test_scan_query_finds_faces(spark, sf_dir):
    """Frames are wide enough for faces: every frame that is looked at has some, and all have vectors, identities and a preview."""
    rows = catalog.QUERIES["scan_recorded"](spark, sf_dir).collect()
    assert rows and all(r.w >= 10 and r.h >= 10 and r.bytes == 4 * r.w * r.h for r in rows)
    first = {r.video: r.face_count for r in rows if r.cluster_id == 0}
    assert first.keys() == {r.video for r in rows} and min(first.values()) >= 2


def test_scan_query_looks_once_a_second(spark, sf_dir):
    """Against plain loops over the frames shown at 0.1 s and every second after it, the reference's rate of sampling."""
    want = {}
    for path in [p for p, _ in list_files(recorded(spark, sf_dir, spots=True), "*.y4m")]:
        video, people = int(os.path.basename(path)[:-4]), {}
        with open(path.removeprefix("file://"), "rb") as file:
            length = Y4M().duration(file)
            frames = {n: np.frombuffer(data, np.uint8).reshape(h, w, 4) for n, _, w, h, data in Y4M().frames(file, 0.0)}
        for n in [3 + 30 * k for k in range(len(frames)) if k + 0.1 < length - 0.1]:
            large = [b for b in _plain_boxes(frames[n]) if b[1][2] - b[1][0] >= 10 and b[1][3] - b[1][1] >= 10]
            for place, (i, _, score) in enumerate(sorted(large, key=lambda b: (b[1][0], b[0]))):
                people.setdefault(place, []).append((-score, n, i))
        for place, own in people.items():
            want[video, place] = (len(own), *min(own)[1:], round(-min(own)[0], 6))
    got = {(r.video, r.cluster_id): (r.face_count, r.frame_index, r.det_id, r.best_confidence) for r in catalog.QUERIES["scan_recorded"](spark, sf_dir).collect()}
    assert got == want and max(r[0] for r in got.values()) >= 30


def test_pixels_and_vectors_are_not_broadcast(spark, tmp_path):
    """Frames that are alike are few bytes in a file, which would make Spark send all their pixels to every task."""
    stages = scan_job.Stages(spark, str(tmp_path))
    frames = stages.run("frames", lambda: _frames(spark))
    boxes = stages.run("detections", lambda: scan_job.detections(frames, catalog.spot_detector))
    for frame in (scan_job.detections(frames, catalog.spot_detector), scan_job.with_vectors(frames, boxes, catalog.spot_recogniser, 2)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
