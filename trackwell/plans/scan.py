"""The scan as one staged job: sample times, frames, heads, detections, vectors, identities and their previews; and a frame's composite without a tracker."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions.geometry import CORNERS
from trackwell.functions.vectors import normalized
from trackwell.operators import detection, identity, matching, models, redaction, sampling
from trackwell.sources.frames import Decoder, frames_at, open_file, store_of, video_info

BY = ["path", "frame_index"]
#: Frames whose models' work makes a task: frames and boxes may be few bytes, so Spark's own sizes would leave all of it to a few tasks.
#: Beyond TASKS tasks of that size, a task takes more of them, up to MOST_FRAMES, as every two tasks of a shuffle have an entry.
TASK_FRAMES, TASKS, MOST_FRAMES = 16, 256, 512
# Pixels and vectors that are alike take few bytes in a stage's files and many in memory, so joins say how they are done; left to the files' sizes, Spark would broadcast whole stages.


class Stages:
    """Tables of a job in a folder, one a stage; a stage that stands there whole is read again instead of being made."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        store, own = store_of(f"{self.folder}/{name}")
        if not store.get_file_info(f"{own}/_SUCCESS").is_file:
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.made.append(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")


def detections(frames: DataFrame, detector: Callable[[], models.Detector], k: int = detection.TOP_K) -> DataFrame:
    """frames(path, frame_index, ts_sec, width, height, rgba) -> boxes (path, frame_index, det_id, corners, confidence) in the frame's own pixels.

    Heads go through `detection.detect` in the square that the model sees; boxes then go back to their frame.
    """
    found = detection.detect(models.head_rows(frames, detector, BY), BY, k=k).drop("rank")
    return models.in_frame(found.join(frames.select(*BY, "width", "height").hint("merge"), BY)).select(*BY, "det_id", *CORNERS, "confidence")


def with_vectors(frames: DataFrame, boxes: DataFrame, recogniser: Callable[[], models.Recogniser], tasks: int | None = None) -> DataFrame:
    """boxes with the unit vector of each face, null where it is too small; a frame meets the list of its boxes, and none without boxes is looked at.

    tasks: how many the frames are dealt over; else Spark decides by bytes.
    """
    lists = boxes.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("det_id", *CORNERS))).alias("boxes"))
    own, lists = (x.repartition(tasks, *BY) if tasks else x for x in (frames, lists))
    found = models.face_vectors(own.join(lists.hint("shuffle_hash"), BY), recogniser, BY)
    return boxes.join(found.hint("merge"), [*BY, "det_id"], "left")


def scan(
    spark: SparkSession, paths: DataFrame, decoder: Decoder, detector: Callable[[], models.Detector], recogniser: Callable[[], models.Recogniser], folder: str,
    fps: float = 1.0, opener: Callable[[str], BinaryIO] = open_file,
) -> dict[str, DataFrame]:
    """paths(path) of video files -> the tables faces, identities and previews, written stage by stage to `folder`.

    Frames are read at the sample times where the files are; heads, detections and vectors follow as stages, so a job that was broken off goes on
    where it stopped. faces(path, frame_index, det_id, ts_sec, corners, confidence, embedding, cluster_id): identities go by place from the left within a
    frame. identities(path, cluster_id, face_count, representative det_id and frame, centroid). previews(path, cluster_id, x, y, w, h, rgba): the
    representative's pixels, null where the rectangle has no area.
    """
    stages = Stages(spark, folder)
    known = stages.run("videos", lambda: video_info(paths, decoder, opener))
    times = sampling.sample_times(known, fps).select("path", "ts")
    n = times.count()
    tasks = max(1, min(-(-n // TASK_FRAMES), max(TASKS, -(-n // MOST_FRAMES))))
    frames = stages.run("frames", lambda: frames_at(times, decoder, opener=opener, tasks=tasks))
    boxes = stages.run("detections", lambda: detections(frames, detector))

    def make_faces() -> DataFrame:
        large = boxes.where((F.col("x2") - F.col("x1") >= 10) & (F.col("y2") - F.col("y1") >= 10))
        timed = with_vectors(frames, large, recogniser, tasks).join(frames.select(*BY, "ts_sec").hint("merge"), BY)
        return identity.by_position(timed, ["path"], "frame_index")

    faces = stages.run("faces", make_faces)

    def make_identities() -> DataFrame:
        best = F.max_by(F.struct("frame_index", "det_id"), F.struct("confidence", (-F.col("frame_index")).alias("f"), (-F.col("det_id")).alias("d")))
        people = faces.groupBy("path", "cluster_id").agg(F.count("*").alias("face_count"), best.alias("best"), F.max("confidence").alias("best_confidence"))
        parts = faces.select("path", "cluster_id", F.posexplode("embedding").alias("i", "v")).groupBy("path", "cluster_id", "i").agg(F.avg("v").alias("m"))
        lists = parts.groupBy("path", "cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
        out = people.join(lists.select("path", "cluster_id", normalized(F.col("mean")).alias("embedding")), ["path", "cluster_id"], "left")
        return out.select("path", "cluster_id", "face_count", F.col("best.frame_index").alias("frame_index"), F.col("best.det_id").alias("det_id"), "best_confidence", "embedding")

    identities = stages.run("identities", make_identities)

    def make_previews() -> DataFrame:
        own = identities.select("path", "cluster_id", "frame_index", "det_id").join(faces.select(*BY, "det_id", *CORNERS), [*BY, "det_id"])
        cut = own.hint("shuffle_hash").join(frames.select(*BY, "width", "height", "rgba"), BY)
        low, high = (lambda c: F.greatest(F.lit(0.0), F.floor(c))), (lambda c, most: F.least(F.col(most).cast("double"), F.ceil(c)))
        rect = {"x": low("x1"), "y": low("y1"), "w": high("x2", "width") - low("x1"), "h": high("y2", "height") - low("y1")}
        return cut.withColumns({n: c.cast("int") for n, c in rect.items()}).select("path", "cluster_id", *rect, models.cropped(*map(F.col, rect)).alias("rgba"))

    return {"faces": faces, "identities": identities, "previews": stages.run("previews", make_previews)}


def composite(
    frames: DataFrame, detector: Callable[[], models.Detector], recogniser: Callable[[], models.Recogniser], identities: DataFrame, chosen: DataFrame,
    default: str = "pixelate", threshold: float = 0.45,
) -> DataFrame:
    """frames with the faces of chosen identities redacted, each frame for itself: detected, recognised, matched to the nearest identity, drawn.

    identities(cluster_id, embedding): unit vectors; chosen(cluster_id, maybe style): whom to redact, with `default` where style is null or missing.
    """
    boxes = with_vectors(frames, detections(frames, detector), recogniser).where("embedding is not null").withColumn("vec_id", F.struct(*BY, "det_id"))
    who = matching.best_by_cosine(boxes.select("vec_id", "embedding"), identities.select(F.col("cluster_id").cast("long").alias("id"), "embedding"), threshold)
    style = F.coalesce("style", F.lit(default)) if "style" in chosen.columns else F.lit(default)
    wanted = who.join(chosen.select(F.col("cluster_id").cast("long").alias("id"), style.alias("style")), "id")
    targets = boxes.join(wanted.select("vec_id", "style"), "vec_id").select(*BY, F.col("det_id").alias("ord"), "style", *CORNERS)
    return redaction.redact_frames(frames, targets, BY)
