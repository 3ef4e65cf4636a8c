"""Tracks: a constant-velocity filter for each coordinate, and the tracker of one video."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filter and the tracker.
POSITION_NOISE, VELOCITY_NOISE, MEASURE_NOISE = 4.0, 2.0, 2.0
MAX_AGE, EVERY = 15, 2
TRACK_IOU, SCAN_IOU, COSINE, LEAST_SIDE = 0.1, 0.15, 0.45, 20


@dataclass
class Axis:
    """Position x, velocity v and their variances, without cross terms."""

    x: float
    v: float = 0.0
    p: float = 10.0
    q: float = 100.0

    def predict(self) -> None:
        self.x += self.v
        self.p += 2 * self.q + POSITION_NOISE
        self.q += VELOCITY_NOISE

    def update(self, z: float) -> None:
        miss, total = z - self.x, self.p + MEASURE_NOISE
        gain, pull = self.p / total, self.q / total
        self.x += gain * miss
        self.v += pull * miss
        self.p *= 1 - gain
        self.q *= 1 - pull


@dataclass
class Track:
    axes: list[Axis]
    age: int = 0

    @classmethod
    def at(cls, box) -> "Track":
        return cls([Axis(float(c)) for c in box])

    @property
    def box(self) -> tuple[float, ...]:
        return tuple(a.x for a in self.axes)

    def predict(self) -> None:
        for a in self.axes:
            a.predict()
        self.age += 1

    def update(self, box) -> None:
        for a, z in zip(self.axes, box):
            a.update(float(z))
        self.age = 0


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a (n, 4) with each of b (m, 4)."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return np.divide(both, area(a)[:, None] + area(b)[None, :] - both, out=np.zeros_like(both), where=both > 0)


@dataclass
class Tracker:
    """State of one video. `scan` lists labelled boxes (identity, box) in scan order; `known` maps identities to unit vectors."""

    scan: list[tuple[int, tuple]] = field(default_factory=list)
    known: dict[int, list[float]] = field(default_factory=dict)
    tracks: dict[int, Track] = field(default_factory=dict)

    def __post_init__(self):
        self._owners = np.array([i for i, _ in self.scan], dtype=np.int64)
        self._boxes = np.array([b for _, b in self.scan], dtype=np.float64).reshape(-1, 4)
        self._people = list(self.known)
        self._vectors = np.array(list(self.known.values()), dtype=np.float64)

    def step(self, frame: int, boxes: list[tuple], vectors: list | None = None) -> list[tuple[int, tuple]]:
        """Advances by one frame; boxes, in order, count on detection frames only. -> (identity, box) of every track."""
        if frame % EVERY:
            for t in self.tracks.values():
                t.predict()
            return [(i, t.box) for i, t in self.tracks.items()]
        self.tracks = {i: t for i, t in self.tracks.items() if t.age <= MAX_AGE}
        for t in self.tracks.values():
            t.predict()
        ids = list(self.tracks)
        scores = overlaps(np.array(boxes, dtype=np.float64).reshape(-1, 4), np.array([t.box for t in self.tracks.values()]).reshape(-1, 4))
        close = np.argwhere(scores >= TRACK_IOU)
        taken: set[int] = set()
        matched: set[int] = set()
        for d, k in sorted(map(tuple, close.tolist()), key=lambda p: (-scores[p], *p)):
            if d not in taken and k not in matched:
                taken.add(d)
                matched.add(k)
                self.tracks[ids[k]].update(boxes[d])
        free = [d for d in range(len(boxes)) if d not in taken] if len(self.scan) else []
        shared_by = overlaps(np.array([boxes[d] for d in free], dtype=np.float64).reshape(-1, 4), self._boxes)
        open_ = ~np.isin(self._owners, ids)
        for d, shared in zip(free, shared_by):  # by a labelled box of the scan that it overlaps most
            box, shared = boxes[d], np.where(open_, shared, 0.0)
            at = int(shared.argmax())  # the first on ties
            if shared[at] > SCAN_IOU:
                open_ &= self._owners != self._owners[at]
                self.tracks[int(self._owners[at])] = Track.at(box)
                taken.add(d)
        for d, box in enumerate(boxes):  # by the likest identity
            vector = vectors[d] if vectors else None
            if d in taken or vector is None or not self._people or box[2] - box[0] < LEAST_SIDE or box[3] - box[1] < LEAST_SIDE:
                continue
            like = self._vectors @ np.asarray(vector, dtype=np.float64)
            like = np.where((like > COSINE) & [i not in self.tracks for i in self._people], like, -np.inf)
            at = int(like.argmax())  # the first on ties
            if like[at] > COSINE:
                self.tracks[self._people[at]] = Track.at(box)
        return [(i, t.box) for i, t in self.tracks.items()]


TRACK_SCHEMA = "video_id long, frame_index long, cluster_id int, x1 double, y1 double, x2 double, y2 double"


def track_group(group: pd.DataFrame, tracker: Tracker, frames: range) -> pd.DataFrame:
    """Runs a tracker over the frames of one video; group: det_id, frame_index, corners, maybe embedding."""
    group = group.sort_values(["frame_index", "det_id"])
    boxes = list(map(tuple, group[["x1", "y1", "x2", "y2"]].to_numpy(dtype=np.float64).tolist()))
    vectors = list(group["embedding"]) if "embedding" in group else None
    at = np.searchsorted(group["frame_index"].to_numpy(), np.arange(frames.start, frames.stop + 1)).tolist()
    out = []
    for f, lo, hi in zip(frames, at, at[1:]):
        out += [(f, i, *box) for i, box in tracker.step(f, boxes[lo:hi], vectors and vectors[lo:hi])]
    return pd.DataFrame(out, columns=["frame_index", "cluster_id", "x1", "y1", "x2", "y2"])


#: Bytes of identities' vectors that may serve all videos at once.
PEOPLE_BYTES = 64_000_000


def shared_people(known: DataFrame) -> dict[int, list[float]]:
    """known(cluster_id, embedding) of all videos, for each task; refused beyond PEOPLE_BYTES, where each video must have its own."""
    own = known.where("embedding is not null").select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector"))
    if (own.agg(F.sum(F.size("vector") * F.lit(8) + F.lit(32)).alias("bytes")).first()["bytes"] or 0) > PEOPLE_BYTES:
        raise ValueError("too many identities for all videos: give known a video_id")
    return {r.cluster_id: list(r.vector) for r in own.collect()}


def track(detections: DataFrame, scan: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """detections(video_id, det_id, frame_index, corners, maybe embedding), scan(video_id, cluster_id, ord, corners) -> a row for each track and frame.

    known(video_id, cluster_id, embedding), unit vectors of each video's identities, brings back
    faces by their embedding that overlap no box of the scan; the smaller cluster_id wins ties. known without video_id serves
    all videos and goes to every task, up to PEOPLE_BYTES. Identities of a video depend on each other, so a video is one task's group; videos run in
    parallel. Frames run from the first detection's to the last one's.
    """

    people = shared_people(known) if known is not None and "video_id" not in known.columns else {}

    def run(key, boxes: pd.DataFrame, labelled: pd.DataFrame) -> pd.DataFrame:
        if boxes.empty:
            return pd.DataFrame(columns=["video_id", "frame_index", "cluster_id", "x1", "y1", "x2", "y2"])
        rows = labelled[labelled["vector"].isna()].sort_values("ord")
        vectors = labelled[labelled["vector"].notna()].sort_values("cluster_id")
        tracker = Tracker(
            scan=[(int(r.cluster_id), (r.left, r.top, r.right, r.bottom)) for r in rows.itertuples()],
            known=dict(sorted({**people, **{int(r.cluster_id): list(r.vector) for r in vectors.itertuples()}}.items())),
        )
        out = track_group(boxes, tracker, range(int(boxes["frame_index"].min()), int(boxes["frame_index"].max()) + 1))
        out.insert(0, "video_id", key[0])
        return out

    # New names: both sides may come from one table, and a cogroup mixes up equal columns.
    corners = [F.col(c).alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), ("left", "top", "right", "bottom"))]
    scan = scan.select(F.col("video_id").alias("video"), "cluster_id", "ord", *corners, F.lit(None).cast("array<double>").alias("vector"))
    if known is not None and "video_id" in known.columns:
        own = known.where("embedding is not null").select(F.col("video_id").alias("video"), "cluster_id", F.col("embedding").cast("array<double>").alias("vector"))
        scan = scan.unionByName(own, allowMissingColumns=True)
    return detections.groupBy("video_id").cogroup(scan.groupBy("video")).applyInPandas(run, TRACK_SCHEMA)


def smooth(observations: DataFrame, by: list[str], value: str) -> DataFrame:
    """observations(by, frame_index, value or null) -> the filter's x, velocity and variances after each frame, from the first value on.

    A track's frames pass through one task in order, batch by batch, and no task holds more of a track than a batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, axis = None, None
        for batch in batches:
            keys = zip(*([str(v) if isinstance(v, float) else v for v in batch.column(b).to_pylist()] for b in by))  # NaN as text: it equals itself
            at, out = [], []
            for n, (key, z) in enumerate(zip(keys, batch.column("_z").to_pylist())):
                if key != now:
                    now, axis = key, None
                if axis is None:
                    if z is None or z != z:
                        continue
                    axis = Axis(z)
                else:
                    axis.predict()
                    if z is not None and z == z:
                        axis.update(z)
                at.append(n)
                out.append((axis.x, axis.v, axis.p, axis.q))
            if at:
                own = batch.select([*by, "frame_index"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, pa.float64()) for c in zip(*out)]], [*by, "frame_index", "x", "v", "p", "q"])

    rows = observations.select(*by, F.col("frame_index").cast("long").alias("frame_index"), F.col(value).cast("double").alias("_z"))
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "frame_index")
    return ordered.mapInArrow(run, ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "frame_index long, x double, v double, p double, q double"]))
