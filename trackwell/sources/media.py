"""Media files as tables: intake, metadata, frames of files whose bytes are in rows already, models over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = "path string, frame_index long, ts_sec double, width int, height int, rgba binary"
LARGE_BYTES = 500 * 1024 * 1024
#: Bytes of frames that go to the JVM in one Arrow batch.
BATCH_BYTES = 32 * 1024 * 1024


def media_files(spark: SparkSession, path: str, pattern: str = "*.{mp4,webm,mov}", content: bool = False) -> DataFrame:
    """(path, file_name, file_size, is_large) of media files; their bytes are read only where content is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = files.withColumns({
        "file_name": F.element_at(F.split("path", "/"), -1), "file_size": F.col("length"), "is_large": F.col("length") > LARGE_BYTES,
    })
    return out.select("path", "file_name", "file_size", "is_large", *(["content"] if content else []))


def video_metadata(files: DataFrame, probe: Callable[[bytes], tuple[float, int, int, float, str]]) -> DataFrame:
    """files(path, file_name, file_size, is_large, content) -> the same without content, and duration, width, height, fps, codec from an injected probe.

    Files are read once. trackwell.sources.frames.video_info reads no more of a file than its header.
    """
    kept = [c for c in files.columns if c != "content"]
    names = ("duration", "width", "height", "fps", "codec")
    kinds = (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [probe(c.as_py()) for c in batch.column("content")]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*kept, *names])

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.select(*kept, "content").mapInArrow(run, f"{fields}, duration double, width int, height int, fps double, codec string")


def decode_frames(
    files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[float, int, int, bytes]]], times: DataFrame | None = None, least_gap: float = 1e-6,
) -> DataFrame:
    """files(path, content) -> frames. The decoder yields (time, width, height, RGBA bytes) in order, one file at a time.

    With times(path, ts), only the frame shown at each of them is kept: the last that begins at or before ts (the first frame for
    earlier ones). Frames leave the task in batches of about BATCH_BYTES.
    """

    timed = times is not None

    def batch_of(path: str, rows: list[tuple]) -> pa.RecordBatch:
        n, ts, w, h, rgba = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(rows)), pa.array(n, pa.int64()), pa.array(ts, pa.float64()), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgba, pa.binary())],
            ["path", "frame_index", "ts_sec", "width", "height", "rgba"],
        )

    def wanted(frames: Iterator[tuple], at: list[float]) -> Iterator[tuple]:
        at, last = sorted(at), None
        for frame in frames:
            shown = False
            while at and last is not None and at[0] + least_gap < frame[1]:
                at.pop(0)
                shown = True
            if shown:
                yield last
            if not at:
                return
            last = frame
        if at and last is not None:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("_times").to_pylist() if timed else [None] * batch.num_rows
            for path, content, at in zip(batch.column("path").to_pylist(), batch.column("content"), given):
                frames = ((n, float(ts), w, h, rgba) for n, (ts, w, h, rgba) in enumerate(decoder(content.as_py())))
                held, size = [], 0
                for frame in wanted(frames, at) if timed else frames:
                    held.append(frame)
                    size += len(frame[4])
                    if size >= BATCH_BYTES:
                        yield batch_of(path, held)
                        held, size = [], 0
                if held:
                    yield batch_of(path, held)

    own = files.select("path", "content")
    if timed:
        own = own.join(times.groupBy("path").agg(F.collect_list("ts").alias("_times")), "path")
    return own.mapInArrow(run, FRAME_SCHEMA)


def run_model(frames: DataFrame, model: Callable[[], Callable], schema: str) -> DataFrame:
    """frames -> rows of an injected model. `model` builds the function of a pandas batch once in each task."""

    def run(batches):
        apply = model()
        for batch in batches:
            yield apply(batch)

    return frames.mapInPandas(run, schema)
