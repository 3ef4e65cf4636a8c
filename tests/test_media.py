"""Pixels, frames and media files, with made-up decoders."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.functions import pixels
from trackwell.operators import redaction
from trackwell.plans import catalog
from trackwell.plans.views import view
from trackwell.sources import media, segments


def _image(w=20, h=16):
    return (np.arange(w * h * 4) * 7 % 251).astype(np.uint8).reshape(h, w, 4)


def test_planes_and_crops():
    image = _image()
    rgb = pixels.without_alpha(image)
    assert (pixels.planes(rgb)[1] == rgb[..., 1].astype(np.float32) / np.float32(255)).all()
    assert (pixels.planes(rgb, (1, 2, 3), (2, 2, 2), backwards=True)[0] == (rgb[..., 2].astype(np.float32) - 3) / 2).all()
    cut = pixels.crop(image, -2, 10, 5, 9)
    assert (cut[:6, 2:] == image[10:16, :3]).all() and not cut[6:].any() and not cut[:, :2].any()
    assert (pixels.resized(image, 20, 16) == image).all()
    boxed = pixels.letterboxed(image, 40)
    assert boxed.shape == (40, 40, 4) and (boxed[:4, :, :3] == 114).all() and (boxed[-4:, :, :3] == 114).all() and (boxed[4, 0] == image[0, 0]).all()


def test_faces_too_small_have_no_input():
    image = _image(200, 160)
    assert pixels.face_input(image, 10, 10, 16, 16) is None
    own = pixels.face_input(image, 50, 50, 90, 100)
    assert own.shape == (3, 112, 112) and own.dtype == np.float32 and -1 <= own.min() < own.max() <= 1


def test_bars_have_round_corners():
    inside = pixels.inside_bar(30, 20, 5, 4, 20, 10, 4)
    assert not inside[4, 5] and inside[4, 12] and inside[9, 5] and inside.sum() < 200
    assert pixels.inside_bar(30, 20, 5, 4, 20, 10, 0).sum() == 200
    assert (pixels.redacted(_image(), "eye-bar", 3, 3, 0, 5) == _image()).all()


def test_frames_are_redacted_in_order(spark):
    """Two frames of different sizes: overlapping regions, one too small, one cut by the edge; a frame without targets."""
    sizes = [(0, 20, 16), (1, 40, 32), (2, 20, 16)]
    frames = spark.createDataFrame([(i, w, h, bytearray(_image(w, h).tobytes()), "x") for i, w, h in sizes], "frame_index long, width int, height int, rgba binary, style string")
    targets = [(0, 2, "black-box", 4.0, 4.0, 12.0, 12.0), (0, 1, "pixelate", 0.0, 0.0, 30.0, 30.0), (0, 3, "black-box", 0.0, 0.0, 1.0, 9.0), (1, 1, "eye-bar", 2.0, 2.0, 34.0, 30.0), (1, 2, "pixelate", 30.0, 20.0, 60.0, 60.0)]
    drawn = redaction.redact_frames(frames, spark.createDataFrame(targets, "frame_index long, ord int, style string, x1 double, y1 double, x2 double, y2 double"), ["frame_index"])
    got = {r.frame_index: np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4) for r in drawn.collect()}
    assert drawn.columns == frames.columns
    first = pixels.redacted(_image(), "pixelate", 0, 0, 20, 16)
    assert (got[0] == pixels.redacted(first, "black-box", 4, 4, 8, 8)).all()
    bar = pixels.redacted(_image(40, 32), "eye-bar", 2 + 32 * 0.05, 2 + 28 * 0.22, 32 * 0.9, 10.0, 4.0)
    assert (got[1] == pixels.redacted(bar, "pixelate", 30, 20, 10, 12)).all()
    assert (got[2] == _image()).all()


def test_media_files_to_frames_and_back(spark, tmp_path):
    def decoder(content):
        for n in range(content[0]):
            yield n / 10, 2, 1, bytes([n] * 8)

    for name, data in (("a.mp4", bytes([25])), ("b.webm", bytes([3])), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files = media.media_files(spark, str(tmp_path), content=True)
    known = media.video_metadata(files, lambda c: (c[0] / 10, 2, 1, 10.0, "made"))
    assert sorted((r.file_name, r.file_size, r.is_large, r.duration, r.width, r.fps) for r in known.collect()) == [("a.mp4", 1, False, 2.5, 2, 10.0), ("b.webm", 1, False, 0.3, 2, 10.0)]
    assert "content" not in known.columns and "content" not in media.media_files(spark, str(tmp_path)).columns
    every = media.decode_frames(files, decoder)
    assert every.count() == 28
    times = files.select("path", F.explode(F.array(F.lit(-1.0), F.lit(0.05), F.lit(0.1), F.lit(1.25), F.lit(9.0))).alias("ts"))
    shown = {}
    for r in media.decode_frames(files, decoder, times).collect():
        shown.setdefault(r.path[-6:], []).append(r.frame_index)
    assert {k.strip("/"): sorted(v) for k, v in shown.items()} == {"a.mp4": [0, 1, 12, 24], "b.webm": [0, 1, 2]}
    segments.write_segments(every.where("path like '%a.mp4'"), f"{tmp_path}/out", ["path"], 10)
    back = segments.read_segments(spark, f"{tmp_path}/out")
    assert [(r.frame_index, r.segment, r.file_name) for r in back.collect()] == [(n, n // 10, f"frame_{n + 1:04d}.jpg") for n in range(25)]


def test_models_run_on_batches(spark):
    def model():
        return lambda batch: batch.assign(twice=batch["id"] * 2)[["id", "twice"]]

    assert sorted(tuple(r) for r in media.run_model(spark.range(5), model, "id long, twice long").collect()) == [(n, 2 * n) for n in range(5)]


def test_assignment_query_against_permutations(spark, sf_dir):
    seen: dict = {}
    for r in view(spark, sf_dir, "obs").where("observed and frame_index < 24").collect():
        seen.setdefault(r.frame_index, []).append((r.x1, r.y1, r.x2, r.y2))

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return 0 if w <= 0 or h <= 0 else w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    got = {r.frame_index: r for r in catalog.QUERIES["hungarian_match"](spark, sf_dir).where("frame_index < 24").collect()}
    for f in (n for n in seen if n - 2 in seen):
        short, long = sorted((seen[f - 2], seen[f]), key=len)
        best = min(sum(1 - overlap(a, long[c]) for a, c in zip(short, p)) for p in itertools.permutations(range(len(long)), len(short)))
        assert got[f].pairs == len(short) and got[f].total == pytest.approx(best, abs=1e-5)

