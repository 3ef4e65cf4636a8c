"""Frames by range from files that a decoder seeks in, and the ordered sink of segments."""

import os
import struct
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trackwell.sources import frames as fr
from trackwell.sources import segments as sg
from trackwell.sources.y4m import Y4M, write_mono

cloudpickle.register_pickle_by_value(sys.modules[__name__])
W, H = 4, 2
SIZE = W * H * 4


class Made:
    """A made-up container: count and frames a second, then raw frames. Seeking goes back to a key frame, every tenth."""

    def __init__(self, log=None):
        self.log = log

    def duration(self, file):
        file.seek(0)
        n, fps = struct.unpack("<id", file.read(12))
        return n / fps

    def frames(self, file, start):
        file.seek(0)
        n, fps = struct.unpack("<id", file.read(12))
        first = max(0, min(int(start * fps), n - 1)) // 10 * 10
        file.seek(12 + first * SIZE)
        read = 0
        try:
            for k in range(first, n):
                data = file.read(SIZE)
                read += 1
                yield k, k / fps, W, H, data
        finally:
            if self.log:
                with open(f"{self.log}/{os.getpid()}", "a") as out:
                    out.write(f"{first} {read}\n")


def _video(path, n, fps, seed):
    with open(path, "wb") as file:
        file.write(struct.pack("<id", n, fps) + b"".join(bytes([(k + seed) % 256]) * SIZE for k in range(n)))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "more").mkdir(parents=True)
    (tmp_path / "log").mkdir()
    _video(tmp_path / "in" / "a.mp4", 250, 10.0, 0)
    _video(tmp_path / "in" / "more" / "b.mov", 7, 5.0, 100)
    (tmp_path / "in" / "c.txt").write_text("x")
    return tmp_path


def _reads(folder):
    return [tuple(map(int, line.split())) for f in (folder / "log").iterdir() for line in f.read_text().splitlines()]


def test_files_are_read_by_range(spark, folder):
    frames = fr.read_frames(spark, f"{folder}/in", Made(folder / "log"), "*.mp4,*.mov", range_bytes=1000)
    assert frames.rdd.getNumPartitions() == 9 + 1
    got = sorted((r.path[-5:], r.frame_index, round(r.ts_sec, 6), r.rgba[0]) for r in frames.collect())
    assert got == [("a.mp4", k, round(k / 10, 6), k % 256) for k in range(250)] + [("b.mov", k, round(k / 5, 6), (k + 100) % 256) for k in range(7)]
    assert max(n for _, n in _reads(folder)) < 60  # no task went through the large file


def test_filters_reach_the_decoder(spark, folder):
    frames = fr.read_frames(spark, f"{folder}/in", Made(folder / "log"), "*.mp4,*.mov", range_bytes=1000)
    late = frames.where("ts_sec >= 20.05 and ts_sec < 20.5")
    assert sorted(r.frame_index for r in late.collect()) == [201, 202, 203, 204]
    assert sum(n for _, n in _reads(folder)) < 30
    one = frames.where(F.col("path") == f"{folder}/in/more/b.mov")
    assert one.count() == 7 and one.rdd.getNumPartitions() == 1
    assert [r.frame_index for r in frames.where("frame_index = 33").collect()] == [33]
    assert frames.where("path = 'none'").collect() == []


def test_frames_at_times(spark, folder):
    a, b = f"{folder}/in/a.mp4", f"{folder}/in/more/b.mov"
    times = [(a, -1.0), (a, 0.0), (a, 0.05), (a, 0.1), (a, 2.55), (a, 12.34), (a, 12.36), (a, 99.0), (a, 99.0), (a, 120.0), (b, 0.39), (b, 0.41), (None, 1.0), (a, None)]
    for span in (60.0, 1.0, 0.01):
        got = fr.frames_at(spark.createDataFrame(times, "path string, ts double"), Made(folder / "log"), span=span)
        assert sorted((r.path, r.frame_index) for r in got.collect()) == [(a, 0), (a, 1), (a, 25), (a, 123), (a, 249), (b, 1), (b, 2)]
    assert max(n for _, n in _reads(folder)) <= 40
    assert fr.frames_at(spark.createDataFrame([], "path string, ts double"), Made()).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("Exchange")  # times are exchanged, frames are not


def test_frames_between_every_two_times(spark, folder):
    """Against the definition, at times of all kinds."""
    a = f"{folder}/in/a.mp4"
    times = [k * 0.037 for k in range(700)]
    want = {min(249, max(0, int((t + 1e-6) * 10))) for t in times}
    got = fr.frames_at(spark.createDataFrame([(a, t) for t in times], "path string, ts double"), Made(), span=3.0)
    assert sorted(r.frame_index for r in got.collect()) == sorted(want)


def test_durations(spark, folder):
    info = fr.video_info(spark.createDataFrame([(f"{folder}/in/a.mp4",)], "path string"), Made())
    assert [r.duration for r in info.collect()] == [25.0]


def _frames(spark, n=25, videos=("x", "y/z")):
    return spark.createDataFrame([(v, k, bytearray([k % 256, i])) for i, v in enumerate(videos) for k in range(n)], "video string, frame_index long, rgba binary")


def test_segments_of_videos_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = _frames(spark).repartition(7)
    sg.write_segments(rows, path, ["video"], size=10)
    parts = sg.manifest(path)["parts"]
    assert [(p["video"], p["segment"], p["rows"]) for p in parts] == [([v], s, n) for v in ("x", "y/z") for s, n in ((0, 10), (1, 10), (2, 5))]
    back = sg.read_segments(spark, path)
    assert [(r.video, r.frame_index, r.segment, r.file_name, bytes(r.rgba)) for r in back.collect()] == [
        (v, k, k // 10, f"frame_{k + 1:04d}.jpg", bytes([k, i])) for i, v in enumerate(("x", "y/z")) for k in range(25)
    ]
    assert "Sort" not in back._jdf.queryExecution().toString()
    some = back.where("video = 'x' and segment = 1")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 10
    files = {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert files == {p["file"] for p in parts} and not [d for d in os.listdir(path) if d.startswith("_")]


def test_more_videos_are_added_and_overwriting_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    sg.write_segments(_frames(spark, 3, ("b",)), path, ["video"])
    sg.write_segments(_frames(spark, 3, ("a",)), path, ["video"])
    assert [r.video for r in sg.read_segments(spark, path).collect()] == ["a"] * 3 + ["b"] * 3
    with pytest.raises(Exception, match="came twice"):
        sg.write_segments(_frames(spark, 3, ("a",)), path, ["video"])
    assert sg.read_segments(spark, path).count() == 6
    sg.write_segments(_frames(spark, 2, ("c",)), path, ["video"], mode="overwrite")
    assert [r.video for r in sg.read_segments(spark, path).collect()] == ["c"] * 2
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 1
    sg.write_segments(_frames(spark).where("false"), path, ["video"], mode="overwrite")
    assert sg.read_segments(spark, path).collect() == []


def test_failed_tasks_leave_nothing(spark, tmp_path):
    """A task that fails in the middle of its frames, once for the job, then for a second attempt that comes through."""
    path = str(tmp_path / "out")
    schema = spark.createDataFrame([], "video string, frame_index long, segment long").schema
    writer = sg.SegmentWriter(path, schema, ["video"], False)

    def batches(fail):
        yield pa.RecordBatch.from_pydict({"video": ["v"] * 3, "frame_index": [0, 1, 2], "segment": [0, 0, 1]})
        if fail:
            raise RuntimeError("lost")
        yield pa.RecordBatch.from_pydict({"video": ["v"], "frame_index": [3], "segment": [1]})

    with pytest.raises(RuntimeError):
        writer.write(batches(True))
    assert not [f for _, _, fs in os.walk(path) for f in fs]
    first, again = writer.write(batches(False)), writer.write(batches(False))
    assert first.parts == again.parts and [p["rows"] for p in again.parts] == [2, 2]
    writer.commit([again, None])
    assert [(r.frame_index, r.segment) for r in sg.read_segments(spark, path).collect()] == [(0, 0), (1, 0), (2, 1), (3, 1)]

    def broken(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    bad = _frames(spark, 5, ("q",)).mapInArrow(broken, "video string, frame_index long, rgba binary")
    with pytest.raises(Exception, match="lost"):
        sg.write_segments(bad, path, ["video"])
    assert {p["video"][0] for p in sg.manifest(path)["parts"]} == {"v"}
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 1


def test_arranged_frames_go_from_file_to_file_without_exchange(spark, folder):
    """Source to sink: tasks of the source write what they read; segments that two tasks hold have two files."""
    frames = fr.read_frames(spark, f"{folder}/in", Made(), "*.mp4,*.mov", range_bytes=1000)
    path = str(folder / "out")
    sg.write_segments(frames, path, ["path"], size=100, arranged=True)
    back = sg.read_segments(spark, path)
    assert [(r.path[-5:], r.frame_index) for r in back.collect()] == [("a.mp4", k) for k in range(250)] + [("b.mov", k) for k in range(7)]
    assert len(sg.manifest(path)["parts"]) > 4


def test_small_ranges_and_parts_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks don't grow with the files where these are small; all frames come, in order, whatever shares a task."""
    sizes = [190_000] * 1_200
    reader = fr.FrameReader([(f"/v/{k}.y4m", n) for k, n in enumerate(sizes)], Y4M(), fr.open_file, 32_768)
    tasks = reader.partitions()
    assert len(tasks) <= 1.2 * fr.TASKS and [r for t in tasks for r in t.ranges] == [fr.Range(f"/v/{k}.y4m", n, n + 1, 6) for k in range(1_200) for n in range(6)]
    assert [s.stop - s.start for s in fr.dealt([fr.RANGE_BYTES] * 1_000)] == [1] * 1_000 and list(fr.dealt([])) == []
    parts = [{"video": [str(k)], "segment": 0, "first": 0, "last": 9, "rows": 10, "bytes": 2_000, "file": str(k)} for k in range(60_000)]
    own = sg.SegmentReader("/s", {"by": ["path"], "parts": parts}).partitions()
    assert len(own) <= 1.2 * fr.TASKS and [f for t in own for f in t.files] == [p["file"] for p in parts]
    rows = spark.range(60).selectExpr("id div 20 as video", "id % 20 as frame_index", "8 as width", "4 as height", "unhex(repeat(lpad(hex(id), 2, '0'), 32)) as luma")
    write_mono(rows, f"{tmp_path}/v", "video").count()
    monkeypatch.setattr(fr, "TASKS", 4)
    reader = fr.FrameReader(fr.list_files(f"{tmp_path}/v", "*.y4m"), Y4M(), fr.open_file, 100)
    tasks = reader.partitions()
    read = [(r["path"][-5:], r["frame_index"], r["rgba"][0]) for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    want = [(f"{v}.y4m", n, 20 * v + n) for v in range(3) for n in range(20)]
    assert len(tasks) <= 6 and read == want
    sg.write_segments(fr.read_frames(spark, f"{tmp_path}/v", Y4M(), "*.y4m"), f"{tmp_path}/s", ["path"], size=7, arranged=True)
    back = sg.SegmentReader(f"{tmp_path}/s", sg.manifest(f"{tmp_path}/s"))
    tasks = back.partitions()
    assert len(tasks) <= 6 and [(r["path"][-5:], r["frame_index"], r["rgba"][0]) for t in tasks for b in back.read(t) for r in b.to_pylist()] == want


def test_frames_at_times_are_dealt_over_the_asked_tasks(spark, folder):
    """Times are few bytes, so left to their size all would be read by one task."""
    files = [p for p, _ in fr.list_files(f"{folder}/in", "*.mp4,*.mov")]
    times = spark.createDataFrame([(p, k / 10) for p in files for k in range(40)], "path string, ts double")
    rows = lambda frame: sorted((r.path, r.frame_index) for r in frame.select("path", "frame_index").collect())
    spread = fr.frames_at(times, Made(), span=0.5, tasks=9)
    assert spread.rdd.getNumPartitions() == 9 and rows(spread) == rows(fr.frames_at(times, Made(), span=0.5))
