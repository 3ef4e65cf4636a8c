"""The tracker as a stateful stream: typed state of each video is kept from batch to batch, with timers that end abandoned ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackwell.operators.tracking import TRACK_SCHEMA, Axis, Track, Tracker, shared_people, track_group

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CORNERS = ("x1", "y1", "x2", "y2")
_BOX = ", ".join(f"{c} double" for c in _CORNERS)
#: A track: position, velocity and their variances for each corner, its age, and its place among the tracks.
_TRACK = ", ".join(f"{c}_{n} double" for c in _CORNERS for n in ("x", "v", "p", "q")) + ", age int, place int"


class VideoTracker(StatefulProcessor):
    """One video: tracks by identity, the scan's boxes, identities' vectors, and the rows of the newest frame, which wait for the next one."""

    def __init__(self, people: dict[int, list[float]], idle_ms: int | None, late: str):
        self.people, self.idle_ms, self.late = people, idle_ms, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "cluster_id int", _TRACK)
        self.scan = handle.getListState("scan", f"ord long, cluster_id int, {_BOX}")
        self.known = handle.getMapState("known", "cluster_id int", "vector array<double>")
        self.held = handle.getListState("held", f"det_id long, frame_index long, {_BOX}, embedding array<double>")
        self.clock = handle.getValueState("clock", "next_frame long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            if r.vector is None:
                self.scan.appendValue((int(r.ord), int(r.cluster_id), *(float(getattr(r, c)) for c in _CORNERS)))
            else:
                self.known.updateValue((int(r.cluster_id),), ([float(v) for v in r.vector],))

    def _tracker(self) -> Tracker:
        boxes = sorted(self.scan.get()) if self.scan.exists() else []
        known = {int(k[0]): list(v[0]) for k, v in self.known.iterator()} if self.known.exists() else {}
        out = Tracker(scan=[(int(r[1]), tuple(r[2:6])) for r in boxes], known=dict(sorted({**self.people, **known}.items())))
        rows = sorted(((v[17], k[0], v) for k, v in self.tracks.iterator()), key=lambda r: r[0]) if self.tracks.exists() else []
        out.tracks = {int(i): Track([Axis(*map(float, v[4 * a : 4 * a + 4])) for a in range(4)], int(v[16])) for _, i, v in rows}
        return out

    def _save(self, tracker: Tracker) -> None:
        if self.tracks.exists():
            self.tracks.clear()
        for place, (i, t) in enumerate(tracker.tracks.items()):
            values = [float(v) for a in t.axes for v in (a.x, a.v, a.p, a.q)]
            self.tracks.updateValue((int(i),), (*values, int(t.age), place))

    def _run(self, key, rows: pd.DataFrame, tracker: Tracker, first: int, stop: int) -> pd.DataFrame:
        out = track_group(rows[rows["frame_index"] < stop], tracker, range(first, stop))
        out.insert(0, "video_id", key[0])
        return out

    def _held(self) -> pd.DataFrame | None:
        rows = list(self.held.get()) if self.held.exists() else []
        return pd.DataFrame(rows, columns=["det_id", "frame_index", *_CORNERS, "embedding"]) if rows else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*([h] if (h := self._held()) is not None else []), *rows])
        then = int(self.clock.get()[0]) if self.clock.exists() else None
        if then is not None and (early := rows["frame_index"] < then).any():
            if self.late == "error":
                raise ValueError(f"video {key[0]}: frame {int(rows['frame_index'].min())} came after frame {then - 1} was done")
            rows = rows[~early]
        ended = bool((rows["det_id"] < 0).any())
        last = int(rows["frame_index"].max()) if len(rows) else None
        rows = rows[rows["det_id"] >= 0]
        first = then if then is not None else int(rows["frame_index"].min()) if len(rows) else None
        stop = last + 1 if ended and last is not None else last
        if first is not None and stop is not None and stop > first:
            tracker = self._tracker()
            yield self._run(key, rows, tracker, first, stop)
            if not ended:
                self._save(tracker)
        if ended:
            self._forget()
            return
        if first is not None:
            self.clock.update((max(first, stop if stop is not None else first),))
        kept = rows[rows["frame_index"] >= (stop if stop is not None else 0)]
        if len(kept):
            self.held.put([
                (int(r.det_id), int(r.frame_index), *(float(getattr(r, c)) for c in _CORNERS), None if r.embedding is None else [float(v) for v in r.embedding])
                for r in kept.itertuples(index=False)
            ])
        elif self.held.exists():
            self.held.clear()
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The video is abandoned: its newest frame is done too, then nothing is kept of it."""
        rows, then = self._held(), self.clock.get() if self.clock.exists() else None
        if rows is not None and then is not None:
            yield self._run(key, rows, self._tracker(), int(then[0]), int(rows["frame_index"].max()) + 1)
        self._forget()

    def _forget(self) -> None:
        for state in (self.tracks, self.scan, self.known, self.held, self.clock):
            if state.exists():
                state.clear()
        for due in list(self.handle.listTimers()) if self.idle_ms is not None else []:
            self.handle.deleteTimer(due)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, scan: DataFrame, known: DataFrame | None = None, idle_ms: int | None = None, late: str = "error") -> DataFrame:
    """detections: a stream of (video_id, det_id, frame_index, corners, maybe embedding) in frame order -> tracks of each video, equal to `tracking.track`.

    scan(video_id, cluster_id, ord, corners) and known(video_id, cluster_id, embedding), batch tables, become the state that a video begins with when the
    query first starts; known without video_id serves all videos and is broadcast, up to a checked size. State is one typed row an identity,
    box or vector in RocksDB. The newest frame of a batch waits for the next batch, as more of its rows may come. A marker row with det_id -1 ends
    a video at its frame, and so does a pause of over idle_ms, if set, in a query that goes on running (one for what is available now would wait for timers without end); state then goes. late: frames that come after a later one was done are
    an error, or left out ("drop").
    """
    if late not in ("error", "drop"):
        raise ValueError("late: error or drop")
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    people = shared_people(known) if known is not None and "video_id" not in known.columns else {}
    corners = [F.col(c).cast("double").alias(c) for c in _CORNERS]
    none = F.lit(None).cast("array<double>")
    begin = scan.select(F.col("video_id").cast("long").alias("video_id"), F.col("cluster_id").cast("int").alias("cluster_id"), F.col("ord").cast("long").alias("ord"), *corners, none.alias("vector"))
    if known is not None and "video_id" in known.columns:
        vectors = known.where("embedding is not null").select(F.col("video_id").cast("long").alias("video_id"), F.col("cluster_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector"))
        begin = begin.unionByName(vectors, allowMissingColumns=True)
    embedding = F.col("embedding").cast("array<double>") if "embedding" in detections.columns else none
    rows = detections.select(F.col("video_id").cast("long").alias("video_id"), F.col("det_id").cast("long").alias("det_id"), F.col("frame_index").cast("long").alias("frame_index"), *corners, embedding.alias("embedding"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        VideoTracker(people, idle_ms, late), TRACK_SCHEMA, "Append", "None" if idle_ms is None else "ProcessingTime", begin.groupBy("video_id"),
    )
