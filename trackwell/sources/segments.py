"""Output frames as an ordered sink: segments of each video in files, named in order by a manifest that the commit writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trackwell.sources.frames import RANGE_BYTES, dealt, store_of

#: Frames of a segment.
SEGMENT = 300
MANIFEST = "manifest.json"


def manifest(path: str) -> dict:
    """What the last commit wrote: the schema, the columns that name a video, and the parts in order."""
    store, own = store_of(path)
    with store.open_input_stream(f"{own}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Written(WriterCommitMessage):
    """The parts of one task: dicts of video (the values of its columns), segment, first and last ordinal, rows, bytes and file."""

    parts: list[dict] = field(default_factory=list)


class SegmentWriter(DataSourceArrowWriter):
    """Writes runs of frames of one segment to files. Files take their names, which don't depend on the attempt, only when their task has come through."""

    def __init__(self, path: str, schema: StructType, by: list[str], overwrite: bool):
        self.path, self.by, self.overwrite = path, by, overwrite
        self.schema = schema.jsonValue()
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, own = store_of(self.path)
        attempt = f"{own}/_attempts-{self.job}/{uuid.uuid4().hex}"
        parts: list[dict] = []
        writer = None
        try:
            for batch in iterator:
                keys = list(zip(*(batch.column(c).to_pylist() for c in (*self.by, "segment"))))
                ordinals = batch.column("frame_index").to_pylist()
                start = 0
                while start < len(keys):
                    stop = start + 1
                    while stop < len(keys) and keys[stop] == keys[start] and ordinals[stop] > ordinals[stop - 1]:
                        stop += 1
                    last = parts[-1] if parts else None
                    if last is None or (*last["video"], last["segment"]) != keys[start] or ordinals[start] <= last["last"]:
                        if writer is not None:
                            writer.close()
                        store.create_dir(attempt)
                        last = {"video": list(keys[start][:-1]), "segment": keys[start][-1], "first": ordinals[start], "rows": 0, "bytes": 0, "temporary": f"{attempt}/{len(parts)}.parquet"}
                        parts.append(last)
                        writer = pq.ParquetWriter(last["temporary"], batch.schema, filesystem=store, use_dictionary=[])
                    run = batch.slice(start, stop - start)
                    writer.write_batch(run)
                    last["last"], last["rows"], last["bytes"] = ordinals[stop - 1], last["rows"] + stop - start, last["bytes"] + run.nbytes
                    start = stop
            if writer is not None:
                writer.close()
                writer = None
            for part in parts:
                folder = "".join(f"/{_plain(c)}={_plain(v)}" for c, v in zip(self.by, part["video"]))
                part["file"] = f"data-{self.job}{folder}/segment-{part['segment']:06d}-{part['first']:09d}.parquet"
                store.create_dir(f"{own}/{part['file'].rsplit('/', 1)[0]}")
                store.move(part.pop("temporary"), f"{own}/{part['file']}")
            return Written(parts)
        except BaseException:
            if writer is not None:
                writer.close()
            raise
        finally:
            if store.get_file_info(attempt).type != fs.FileType.NotFound:
                store.delete_dir(attempt)

    def _sweep(self, folders: list[str]) -> None:
        store, own = store_of(self.path)
        for folder in folders:
            if store.get_file_info(f"{own}/{folder}").type != fs.FileType.NotFound:
                store.delete_dir(f"{own}/{folder}")

    def commit(self, messages: list[Written | None]) -> None:
        store, own = store_of(self.path)
        store.create_dir(own)
        known = store.get_file_info(f"{own}/{MANIFEST}").type != fs.FileType.NotFound
        old = manifest(self.path) if known else {"parts": []}
        before = [] if self.overwrite else old["parts"]
        order = lambda p: ([(v is None, v) for v in p["video"]], p["segment"], p["first"])
        parts = sorted([*before, *(p for m in messages if m is not None for p in m.parts)], key=order)
        for a, b in zip(parts, parts[1:]):
            if a["video"] == b["video"] and b["first"] <= a["last"]:
                self.abort(messages)
                raise ValueError(f"frames of video {b['video']} from {b['first']} on came twice or out of order")
        named = {p["file"] for p in parts}
        with store.open_output_stream(f"{own}/{MANIFEST}.{self.job}") as file:
            file.write(json.dumps({"schema": self.schema, "by": self.by, "parts": parts}).encode())
        store.move(f"{own}/{MANIFEST}.{self.job}", f"{own}/{MANIFEST}")
        gone = {p["file"].split("/")[0] for p in old["parts"]} - {f.split("/")[0] for f in named}
        self._sweep([*sorted(gone), f"_attempts-{self.job}"])

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep([f"data-{self.job}", f"_attempts-{self.job}"])


def _plain(value) -> str:
    """A value in a file name: what isn't a letter, digit, dot or dash is written as its bytes."""
    return "".join(c if c.isascii() and (c.isalnum() or c in ".-") else "".join(f"%{b:02x}" for b in c.encode()) for c in str(value))


@dataclass
class Parts(InputPartition):
    files: list[str]


class SegmentReader(DataSourceReader):
    """Tasks of one part or of several small neighbours, in the manifest's order; filters on the video's columns and the segment leave files out."""

    def __init__(self, path: str, found: dict):
        self.path, self.by, self.parts = path, found["by"], found["parts"]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and (column == "segment" or column in self.by):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                own = (lambda p: p["segment"]) if column == "segment" else (lambda p, k=self.by.index(column): p["video"][k])
                self.parts = [p for p in self.parts if own(p) in wanted]
            else:
                yield f

    def partitions(self) -> list[Parts]:
        files = [p["file"] for p in self.parts]
        return [Parts(files[run]) for run in dealt([p.get("bytes", RANGE_BYTES) for p in self.parts])] or [Parts([])]

    def read(self, part: Parts) -> Iterator[pa.RecordBatch]:
        store, own = store_of(self.path)
        for name in part.files:
            with store.open_input_file(f"{own}/{name}") as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=64)


class Segments(DataSource):
    """Frames of videos by segment: read in order, written with a manifest. Option by: the columns, comma-joined, that name a video."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> StructType:
        return StructType.fromJson(manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], manifest(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"], schema, [c for c in self.options.get("by", "path").split(",") if c], overwrite)


def write_segments(frames: DataFrame, path: str, by: list[str], size: int = SEGMENT, arranged: bool = False, mode: str = "append") -> None:
    """frames(by, frame_index, ...) as files of (video, segment), and a manifest of them in order; columns segment and file_name are added.

    by: the columns that name a video. The frames of a segment come to one task and are put in order there; where `arranged`, each
    task's frames of a video are in order already, as those of a frame source are, and nothing is exchanged: a segment that
    several tasks hold has several files. Tasks that fail, and jobs that fail, leave no file; frames that come twice
    are refused by the commit. Null names are a video of their own; an empty table makes an empty manifest. mode: append or overwrite.
    """
    out = frames.withColumns({
        "segment": F.floor(F.col("frame_index") / size).cast("long"), "file_name": F.format_string("frame_%04d.jpg", F.col("frame_index") + 1),
    })
    if not arranged:
        out = out.repartition(*by, "segment").sortWithinPartitions(*by, "segment", "frame_index")
    frames.sparkSession.dataSource.register(Segments)
    out.write.format("segments").option("by", ",".join(by)).mode(mode).save(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all segments again: videos, segments and ordinals in order as the manifest has them, without a sort."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Segments)
    return spark.read.format("segments").load(path)
