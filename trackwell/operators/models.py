"""Model inputs and outputs as DataFrame operators: pixels of frames to planes in bounded Arrow batches, an injected model's heads and vectors to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.functions import pixels
from trackwell.functions.geometry import letterbox
from trackwell.operators.detection import INPUT

#: Frames, and faces, that a model gets at once.
FRAMES, FACES = 8, 64
STRIDES = (8, 16, 32)
#: detector: planes (n, 3, side, side) -> for each stride an array (n, cells, 6) of cls, obj, dx, dy, dw, dh.
Detector = Callable[[np.ndarray], dict[int, np.ndarray]]
#: recogniser: planes (n, 3, 112, 112) -> vectors (n, d).
Recogniser = Callable[[np.ndarray], np.ndarray]


def _images(kind: str, change: Callable[..., np.ndarray | None]):
    """A function of (rgba, width, height, more...) columns that changes each frame's pixels; null pixels, and None, give null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rgba, width, height, *more in batches:
            out = []
            for data, w, h, *own in zip(rgba, width.to_pylist(), height.to_pylist(), *(m.to_pylist() for m in more)):
                made = change(pixels.frame(data.as_py(), w, h), *own) if data.is_valid and w is not None and h is not None and None not in own else None
                out.append(None if made is None else made.tobytes() if kind == "binary" else made.ravel())
            yield pa.array(out, pa.binary() if kind == "binary" else pa.list_(pa.float32()))

    return run


_FRAME = ("rgba", "width", "height")


def rgb(rgba: str = "rgba") -> Column:
    """The bytes of a frame without alpha."""
    return _images("binary", pixels.without_alpha)(rgba, *_FRAME[1:])


def planes(mean=(0.0, 0.0, 0.0), spread=(255.0, 255.0, 255.0), backwards: bool = False) -> Column:
    """Planes of single precision, one after the other: (value - mean) / spread; backwards: blue first."""
    return _images("array<float>", lambda image: pixels.planes(pixels.without_alpha(image), mean, spread, backwards))(*_FRAME)


def letterboxed(side: int) -> Column:
    """RGBA bytes of the frame fitted into a square; geometry.letterbox has the numbers."""
    return _images("binary", lambda image: pixels.letterboxed(image, side))(*_FRAME)


def cropped(x: Column, y: Column, w: Column, h: Column) -> Column:
    """RGBA bytes of a rectangle; what lies outside the frame is transparent black, a rectangle without area gives null."""
    whole = [c.cast("int") for c in (x, y, w, h)]
    return _images("binary", lambda image, *r: pixels.crop(image, *r) if r[2] > 0 and r[3] > 0 else None)(*_FRAME, *whole)


def detector_input(image: np.ndarray, side: int = INPUT, out: np.ndarray | None = None) -> np.ndarray:
    """Planes of raw values of a frame fitted into the detector's square, in `out` if given."""
    out = np.empty((3, side, side), np.float32) if out is None else out
    out[:] = (pixels.letterboxed(image, side) if image.shape[:2] != (side, side) else image)[..., :3].transpose(2, 0, 1)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def head_rows(frames: DataFrame, make: Callable[[], Detector], by: list[str], side: int = INPUT, least: float = 0.0, batch: int = FRAMES) -> DataFrame:
    """frames(by, width, height, rgba) -> a row for each cell of each head: by, head_ord, stride, cell, det_id, cls, obj, dx, dy, dw, dh.

    make() builds the model once in each task; it gets `batch` frames at a time, fitted into a square (`in_frame` undoes that). det_id is head_ord * 2^32 +
    cell: the order of heads, then of cells, decides between equal scores in `detection.detect` and is unique in its frame. Cells whose cls or obj is not over `least` can have
    no score and are left out where least is 0, which changes nothing after the detector's threshold. Null pixels have no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", head_ord int, stride int, cell int, det_id long, cls double, obj double, dx double, dy double, dw double, dh double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tensor = make(), np.empty((batch, 3, side, side), np.float32)  # one array for all batches of a task
        for part in _chunks(batches, batch):
            part = part.filter(part.column("rgba").is_valid())
            if not part.num_rows:
                continue
            for own, data, w, h in zip(tensor, part.column("rgba"), part.column("width").to_pylist(), part.column("height").to_pylist()):
                detector_input(pixels.frame(data.as_py(), w, h), side, own)
            heads = model(tensor[: part.num_rows])
            for order, stride in enumerate(STRIDES):
                values = np.asarray(heads[stride], np.float64)
                frame, cell = np.nonzero((values[:, :, 0] > least) & (values[:, :, 1] > least))
                own = values[frame, cell]
                rows = part.select(by).take(pa.array(frame))
                made = [np.full(len(frame), order, np.int32), np.full(len(frame), stride, np.int32), cell.astype(np.int32), (order << 32) + cell.astype(np.int64), *own.T]
                names = [*by, "head_ord", "stride", "cell", "det_id", "cls", "obj", "dx", "dy", "dw", "dh"]
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(np.ascontiguousarray(m)) for m in made]], names)

    return frames.select(*by, "width", "height", "rgba").mapInArrow(run, schema)


def in_frame(boxes: DataFrame, side: int = INPUT) -> DataFrame:
    """boxes(x1 … y2, width, height) of the square that a frame was fitted into, back in the frame and cut to it."""
    fit = letterbox(F.col("width"), F.col("height"), side)

    def back(c: str, pad: str, most: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(most).cast("double"), (F.col(c) - fit[pad]) / fit["scale"]))

    return boxes.withColumns({"x1": back("x1", "pad_x", "width"), "x2": back("x2", "pad_x", "width"), "y1": back("y1", "pad_y", "height"), "y2": back("y2", "pad_y", "height")})


def face_vectors(faces: DataFrame, make: Callable[[], Recogniser], carried: list[str], ratio: float = 0.2, batch: int = FACES) -> DataFrame:
    """faces(carried, rgba, width, height, boxes: array of (det_id, x1, y1, x2, y2)) -> (carried, det_id, embedding) of every box, of unit length.

    A frame comes once, with all its faces. make() builds the model once in each task; it gets at most `batch` faces at a time. The embedding is null where the grown box
    is under ten pixels, and where the model's vector has no length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in faces.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", det_id long, embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def vectors(inputs: list[np.ndarray]) -> list[list[float] | None]:
            if not inputs:
                return []
            found = np.asarray(model(np.stack(inputs)), np.float64)
            length = np.sqrt((found * found).sum(axis=1))
            return [(v / n).tolist() if n > 0 else None for v, n in zip(found, length)]

        for part in _chunks(batches, 1):
            image = pixels.frame(part.column("rgba")[0].as_py(), part.column("width")[0].as_py(), part.column("height")[0].as_py()) if part.column("rgba").is_valid()[0].as_py() else None
            boxes = part.column("boxes")[0].as_py() or []
            for start in range(0, len(boxes), batch):
                own = boxes[start : start + batch]
                inputs = [None if image is None else pixels.face_input(image, *(b[c] for c in ("x1", "y1", "x2", "y2")), ratio) for b in own]
                found = iter(vectors([i for i in inputs if i is not None]))
                rows = part.select(carried).take(pa.array([0] * len(own)))
                embedding = pa.array([None if i is None else next(found) for i in inputs], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([b["det_id"] for b in own], pa.int64()), embedding], [*carried, "det_id", "embedding"])

    return faces.select(*carried, "rgba", "width", "height", "boxes").mapInArrow(run, schema)
