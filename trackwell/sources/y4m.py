"""Uncompressed video (YUV4MPEG2): a decoder that seeks, for the frame source, and files written from frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackwell.sources.frames import store_of

MARK = b"FRAME"


@dataclass
class Header:
    width: int
    height: int
    rate: Fraction
    colour: str
    begin: int

    @property
    def planes(self) -> list[tuple[int, int]]:
        """(height, width) of each plane."""
        full = self.height, self.width
        if self.colour == "mono":
            return [full]
        if self.colour == "444":
            return [full] * 3
        half = (self.height + 1) // 2 if self.colour == "420" else self.height, (self.width + 1) // 2
        return [full, half, half]

    @property
    def size(self) -> int:
        return sum(h * w for h, w in self.planes)


def header(file: BinaryIO) -> Header:
    """The first line of a file; frames of eight bits a sample, mono or in 4:2:0, 4:2:2 or 4:4:4."""
    file.seek(0)
    line = file.read(256).split(b"\n", 1)[0]
    kind, *tags = line.decode("ascii", "replace").split(" ")
    found = {t[0]: t[1:] for t in tags if t}
    colour = found.get("C", "420")
    colour = "420" if colour in ("420", "420jpeg", "420mpeg2", "420paldv") else colour
    if kind != "YUV4MPEG2" or colour not in ("mono", "420", "422", "444") or not {"W", "H", "F"} <= set(found):
        raise ValueError("not a YUV4MPEG2 file of eight bits a sample")
    return Header(int(found["W"]), int(found["H"]), Fraction(*map(int, found["F"].split(":"))), colour, len(line) + 1)


def rgba(data: bytes, head: Header) -> bytes:
    """A frame's planes as RGBA bytes. Mono stands for itself, colour is BT.601 of limited range; chroma is repeated where it is coarser."""
    out = np.full((head.height, head.width, 4), 255, np.uint8)
    planes, at = [], 0
    for h, w in head.planes:
        plane = np.frombuffer(data, np.uint8, h * w, at).reshape(h, w)
        at += h * w
        tall, wide = -(-head.height // h), -(-head.width // w)
        planes.append(np.repeat(np.repeat(plane, tall, axis=0), wide, axis=1)[: head.height, : head.width])
    if head.colour == "mono":
        out[..., :3] = planes[0][..., None]
        return out.tobytes()
    y, u, v = (p.astype(np.float64) for p in planes)
    y, u, v = (y - 16) * 255 / 219, (u - 128) * 255 / 224, (v - 128) * 255 / 224
    mixed = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=2)
    out[..., :3] = np.clip(np.floor(mixed + 0.5), 0, 255)
    return out.tobytes()


class Y4M:
    """The decoder. A frame begins with a line of its own, nearly always bare, so a frame's place is known; where a line has tags, frames are walked."""

    def _places(self, file: BinaryIO, head: Header) -> tuple[int, int]:
        """Bytes of the file, and of a frame with a bare line."""
        file.seek(0, 2)
        return file.tell(), len(MARK) + 1 + head.size

    def duration(self, file: BinaryIO) -> float:
        head = header(file)
        end, step = self._places(file, head)
        return float((end - head.begin) // step / head.rate)

    def frames(self, file: BinaryIO, start: float) -> Iterator[tuple[int, float, int, int, bytes]]:
        head = header(file)
        end, step = self._places(file, head)
        n = min(max(0, int(start * head.rate)), max(0, (end - head.begin) // step - 1))
        file.seek(head.begin + n * step)
        if file.read(len(MARK) + 1) != MARK + b"\n":  # tags somewhere before: walk from the beginning
            n = 0
        file.seek(head.begin + n * step)
        while True:
            line = file.read(len(MARK) + 1)
            while line and not line.endswith(b"\n"):
                more = file.read(1)
                line = line + more if more else b""
            data = file.read(head.size) if line.startswith(MARK) else b""
            if len(data) < head.size:
                return
            yield n, float(n / head.rate), head.width, head.height, rgba(data, head)
            n += 1


def write_mono(frames: DataFrame, folder: str, by: str, rate: int = 30) -> DataFrame:
    """frames(by, frame_index, width, height, luma) -> (by, path, n_frames): a mono file of each video, its frames in order.

    A video's frames come to one task, in order, and pass through it one by one. A file takes its name when it is whole.
    """
    kind = frames.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = store_of(folder)
        store.create_dir(own)
        done, out, now, n = [], None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{own}/{now}.part", f"{own}/{now}.y4m")
                done.append((now, f"{folder}/{now}.y4m", n))

        for batch in batches:
            for video, w, h, luma in zip(*(batch.column(c).to_pylist() for c in (by, "width", "height", "luma"))):
                if out is None or video != now:
                    close()
                    now, n = video, 0
                    out = store.open_output_stream(f"{own}/{now}.part")
                    out.write(f"YUV4MPEG2 W{w} H{h} F{rate}:1 Ip A1:1 Cmono\n".encode())
                out.write(MARK + b"\n" + luma)
                n += 1
        close()
        columns = list(zip(*done)) or [()] * 3
        kinds = (batch.schema.field(by).type if done else None, pa.string(), pa.int64())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [by, "path", "n_frames"])

    dealt = frames.select(by, "frame_index", "width", "height", "luma").repartition(by).sortWithinPartitions(by, "frame_index")
    return dealt.mapInArrow(run, f"`{by}` {kind}, path string, n_frames long")
