"""Registered queries over the reference's operators and their DuckDB counterparts."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.functions import geometry, naming, vectors
from trackwell.operators import detection, identity, long_tracks, matching, neighbours, redaction, rounds, sampling, selection, tracking
from trackwell.plans import scan as scan_job
from trackwell.plans.sql import SQL
from trackwell.plans.views import progress, recorded, shared_folder, table, view
from trackwell.sources import frames as frame_files
from trackwell.sources import segments as segment_files
from trackwell.sources.y4m import Y4M
from trackwell.streaming import tracker as tracking_stream

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


CORNERS = geometry.CORNERS


@query
def nms_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return detection.suppress(view(spark, d, "boxes"), ["frame_index"]).select("frame_index", "det_id", "confidence")


@query
def nms_crowded(spark: SparkSession, d: str) -> DataFrame:
    """The same boxes by rounds over an edge table, 50 of the others' frames as one: for frames that are too crowded to be collected."""
    boxes = view(spark, d, "boxes").withColumn("frame_index", F.floor(F.col("frame_index") / 50))
    return rounds.suppress_crowded(boxes, ["frame_index"], detection.OVERLAP).select("frame_index", "det_id", "confidence")


@query
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    boxes = view(spark, d, "boxes")
    return rounded(matching.overlap_pairs(boxes, boxes, ["frame_index"]).where("det_a < det_b"), "iou")


@query
def iou_pairs_grid(spark: SparkSession, d: str) -> DataFrame:
    boxes = view(spark, d, "boxes")
    return rounded(matching.overlap_pairs_by_cell(boxes, boxes, ["frame_index"]).where("det_a < det_b"), "iou")


@query
def shape_filter(spark: SparkSession, d: str) -> DataFrame:
    return detection.shape_filter(view(spark, d, "boxes")).select("det_id", "frame_index")


@query
def expand_box(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "boxes").withColumns(geometry.expanded(0.2, 640.0, 480.0)).select("det_id", *CORNERS)


@query
def anchor_decode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detection.decode_anchors(view(spark, d, "anchors")), "confidence", *CORNERS, digits=4).select("anchor_id", "frame_index", "confidence", *CORNERS)


@query
def topk_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return detection.top_k(view(spark, d, "boxes"), ["frame_index"], 3).select("frame_index", "det_id", F.col("rank").cast("long").alias("rank"))


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("u", vectors.normalized(F.col("embedding")))
    return rounded(v.select("vec_id", vectors.norm(F.col("embedding")).alias("norm"), F.get("u", F.lit(0)).alias("first"), vectors.norm(F.col("u")).alias("unit")), "norm", "first", "unit")


@query
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors whose dot product exceeds 0.2."""
    return rounded(matching.cosine_links(table(spark, d, "embeddings"), 0.2), "sim", digits=5)


@query
def cosine_pairs_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by pivots, which spare vectors that cluster from meeting all others."""
    return rounded(neighbours.cosine_links_pruned(table(spark, d, "embeddings"), 0.2), "sim", digits=5)


@query
def centroids(spark: SparkSession, d: str) -> DataFrame:
    out = identity.centroids(table(spark, d, "embeddings"), "label").select("label", F.posexplode("embedding").alias("i", "v"))
    return rounded(out.select("label", F.col("i").cast("long").alias("i"), "v"), "v")


@query
def identity_match_top1(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    known = identity.centroids(v, "label").withColumnRenamed("label", "id")
    return rounded(matching.best_by_cosine(v, known, 0.2), "sim", digits=5)


@query
def identity_match_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same identities by pivots, for more of them than can be broadcast."""
    v = table(spark, d, "embeddings")
    known = identity.centroids(v, "label").withColumnRenamed("label", "id")
    return rounded(neighbours.best_by_cosine_pruned(v, known, 0.2), "sim", digits=5)


@query
def position_identity(spark: SparkSession, d: str) -> DataFrame:
    out = identity.by_position(view(spark, d, "boxes"), [], "frame_index")
    return out.select("det_id", "frame_index", F.col("cluster_id").cast("long").alias("cluster_id"))


@query
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    out = identity.summary(identity.by_position(view(spark, d, "boxes"), [], "frame_index"), ["cluster_id"])
    return out.withColumn("cluster_id", F.col("cluster_id").cast("long"))


def _steps(spark: SparkSession, d: str, least: float) -> DataFrame:
    """Overlaps of observed boxes with those two frames later."""
    obs = view(spark, d, "obs").where("observed").select("frame_index", "det_id", *CORNERS)
    return matching.overlap_pairs(obs.withColumn("frame_index", F.col("frame_index") + 2), obs, ["frame_index"], least)


@query
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.greedy(_steps(spark, d, 0.0).where("iou >= 0.1"), ["frame_index"], "det_a", "det_b", "iou"), "iou")


@query
def greedy_crowded(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by rounds of pairs that are the best of both sides."""
    return rounded(rounds.greedy_crowded(_steps(spark, d, 0.0).where("iou >= 0.1"), ["frame_index"], "det_a", "det_b", "iou"), "iou")


@query
def seq_match_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.in_turn(_steps(spark, d, 0.3), ["frame_index"], "det_a", "det_b", "iou"), "iou")


@query
def interpolate_boxes(spark: SparkSession, d: str) -> DataFrame:
    obs = view(spark, d, "obs")
    matches = matching.in_turn(_steps(spark, d, 0.3), ["frame_index"], "det_a", "det_b", "iou")
    return rounded(matching.interpolate(matches, obs, obs, 0.5), *CORNERS, "confidence")


@query
def nearest_sample_match(spark: SparkSession, d: str) -> DataFrame:
    obs = view(spark, d, "obs").withColumn("ts", F.col("frame_index") / 30.0).withColumn("video", F.floor(F.col("frame_index") / 250))
    samples = obs.where("frame_index % 30 = 0")
    return matching.nearest_sample(obs, samples, ["video"])


@query
def sample_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.sample_times(view(spark, d, "videos")).select("id", "ts"), "ts")


@query
def frame_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.frame_times(view(spark, d, "videos")).select("id", "frame_index", "ts"), "ts")


@query
def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stride(view(spark, d, "boxes")).groupBy("frame_index").agg(F.count("*").alias("n"))


@query
def segments(spark: SparkSession, d: str) -> DataFrame:
    return sampling.segments(view(spark, d, "boxes"), [])


@query
def kalman_batch(spark: SparkSession, d: str) -> DataFrame:
    """All four coordinates of each object, measured on detection frames."""
    seen = F.col("observed") & (F.col("frame_index") % 2 == 0)
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.when(seen, F.col(c)).alias("z")) for c in CORNERS]))
    out = tracking.smooth(view(spark, d, "obs").select("obj_id", "frame_index", axes.alias("a")).select("obj_id", "frame_index", "a.*"), ["obj_id", "axis"], "z")
    return rounded(out, "x", "v", "p", "q", digits=4)


@query
def kalman_long(spark: SparkSession, d: str) -> DataFrame:
    """The same by blocks of 256 frames, whose values are spread over tasks: for tracks that are too long for one."""
    seen = F.col("observed") & (F.col("frame_index") % 2 == 0)
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.when(seen, F.col(c)).alias("z")) for c in CORNERS]))
    rows = view(spark, d, "obs").select("obj_id", "frame_index", axes.alias("a")).select("obj_id", "frame_index", "a.*")
    return rounded(long_tracks.smooth_long(rows, ["obj_id", "axis"], "z", span=256), "x", "v", "p", "q", digits=4)


@query
def track_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Frames since an object's last observation on a detection frame, and whether a track would still be there."""
    from pyspark.sql import Window

    seen = F.when(F.col("observed") & (F.col("frame_index") % 2 == 0), F.col("frame_index"))
    last = F.last(seen, ignorenulls=True).over(Window.partitionBy("obj_id").orderBy("frame_index"))
    out = view(spark, d, "obs").select("obj_id", "frame_index", (F.col("frame_index") - last).alias("since")).where("since is not null")
    return out.withColumn("alive", F.col("since") <= tracking.MAX_AGE + 2)


def _faces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections with embeddings, labelled boxes of the scan, and the identities' vectors.

    An object's embedding is its label's centroid, mixed with the vector whose vec_id is the detection's, where there is one. The scan of each video leaves out
    two of the eight objects, which only their embedding can bring in.
    """
    obs = view(spark, d, "obs").withColumn("video_id", F.floor(F.col("frame_index") / 250))
    labelled = obs.where("frame_index % 30 = 0 and (obj_id + video_id) % 4 <> 3")
    scan = labelled.select("video_id", F.col("obj_id").alias("cluster_id"), F.col("det_id").alias("ord"), *CORNERS)
    v = table(spark, d, "embeddings")
    people = identity.centroids(v, "label").select(F.col("label").cast("int").alias("cluster_id"), "embedding")
    own = _unit(v.select(F.col("vec_id").alias("det_id"), F.col("embedding").alias("own")), "own")
    mixed = F.zip_with("embedding", "own", lambda a, b: a + b * 0.5)
    dets = obs.where("observed").join(people.withColumnRenamed("cluster_id", "obj_id"), "obj_id", "left").join(own, "det_id", "left")
    faces = _unit(dets.withColumn("embedding", F.explode(F.array(F.coalesce(mixed, F.col("embedding"))))), "embedding")
    return faces.select("video_id", "det_id", "frame_index", *CORNERS, "embedding"), scan, people


def _unit(frame: DataFrame, name: str) -> DataFrame:
    """frame with a vector column of unit length; generators of one row keep the length from being worked out again for every entry."""
    long = frame.withColumn("_norm", F.explode(F.array(vectors.norm(F.col(name)))))
    return long.withColumn(name, F.explode(F.array(F.transform(name, lambda x: x.cast("double") / F.col("_norm"))))).drop("_norm")


@query
def tracker_full(spark: SparkSession, d: str) -> DataFrame:
    """Tracks over detections, scan and embeddings, see _faces."""
    return rounded(tracking.track(*_faces(spark, d)), *CORNERS, digits=4)


@query
def hungarian_match(spark: SparkSession, d: str) -> DataFrame:
    """The best assignment of the observed boxes of each frame to those two frames later: 1 - IoU in all."""
    obs = view(spark, d, "obs").where("observed").select("frame_index", "det_id", F.struct(*CORNERS).alias("b"))
    before = obs.select((F.col("frame_index") + 2).alias("frame_index"), F.col("det_id").alias("row"), F.col("b").alias("a"))
    cost = before.join(obs.withColumnRenamed("det_id", "col"), "frame_index").withColumn("cost", 1 - geometry.iou(F.col("a"), F.col("b"))).drop("a", "b")
    total = matching.optimal(cost, ["frame_index"]).groupBy("frame_index")
    return rounded(total.agg(F.sum("cost").alias("total"), F.count("*").alias("pairs")), "total")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return identity.by_position(view(spark, d, "boxes"), [], "frame_index").withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query
def selection_semi(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.range(0, 8).where("id % 2 = 0").select(F.col("id").alias("cluster_id"))
    return _labelled(spark, d).join(chosen, "cluster_id", "left_semi").select("det_id", "cluster_id")


@query
def unmatched_anti(spark: SparkSession, d: str) -> DataFrame:
    matched = matching.greedy(_steps(spark, d, 0.0).where("iou >= 0.1"), ["frame_index"], "det_a", "det_b", "iou").select(F.col("det_b").alias("det_id"))
    return view(spark, d, "obs").where("observed").join(matched, "det_id", "left_anti").select("det_id", "frame_index")


@query
def style_coalesce(spark: SparkSession, d: str) -> DataFrame:
    overrides = spark.createDataFrame([(1, "eye-bar"), (3, "black-box")], "cluster_id long, style string")
    return redaction.styles(_labelled(spark, d).select("det_id", "cluster_id"), overrides, "pixelate")


@query
def redaction_geometry(spark: SparkSession, d: str) -> DataFrame:
    style = F.element_at(F.array(*[F.lit(s) for s in ("pixelate", "eye-bar", "eye-bar-fine", "black-box")]), (F.col("det_id") % 4 + 1).cast("int"))
    out = redaction.regions(view(spark, d, "boxes").withColumn("style", style), 640, 480)
    return rounded(out, "rx", "ry", "rw", "rh", "radius").select("det_id", "style", "rx", "ry", "rw", "rh", "radius")


@query
def mosaic_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block means of an image 100 pixels wide, one for each event."""
    e, at = table(spark, d, "events"), F.col("event_id")
    image = e.select((at % 100).alias("x"), F.floor(at / 100).alias("y"), (at * 7 % 256).alias("r"), ((at * 13 + F.col("user_id")) % 256).alias("g"))
    return rounded(redaction.block_means(image, F.col("x"), F.col("y"), ["r", "g"]), "r", "g")


@query
def toggle_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.toggled(table(spark, d, "events"), ["user_id"], "event_type")


@query
def latest_override(spark: SparkSession, d: str) -> DataFrame:
    return selection.latest(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    return selection.overall_percent(progress(spark, d)).select("event_id", "phase", "phase_percent", "overall_percent")


@query
def names(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", naming.frame_name(F.col("page_id") + 1).alias("frame"), naming.output_name(F.col("url")).alias("output"), naming.phase_label(F.col("url")).alias("label"))


@query
def letterbox_params(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rounded(view(spark, d, "boxes").select("det_id", geometry.letterbox(w, h, 640).alias("l")).select("det_id", "l.*"), "scale")


@query
def actual_fps(spark: SparkSession, d: str) -> DataFrame:
    chunks = view(spark, d, "boxes").select((F.col("frame_index") % 7).alias("video"), (F.col("det_id") % 10 == 0).alias("is_key"), ((F.col("frame_index") % 7) * 3.5).alias("duration"))
    return rounded(sampling.actual_rate(chunks, ["video"], "duration"), "fps")


@query
def detector_tail(spark: SparkSession, d: str) -> DataFrame:
    """Head rows to detections: decoded, strong, not overlapped, of likely shape, the 20 best of each frame."""
    rows = view(spark, d, "anchors").withColumnRenamed("anchor_id", "det_id")
    return detection.detect(rows, ["frame_index"], k=20).select("frame_index", "det_id", F.col("rank").cast("long").alias("rank"))


@query
def head_union(spark: SparkSession, d: str) -> DataFrame:
    """The tables of three strides as one, ordered by head and cell within each frame."""
    rows = view(spark, d, "anchors")
    return detection.heads([rows.where(F.col("stride") == s) for s in (8, 16, 32)]).groupBy("frame_index", F.col("head_ord").cast("long").alias("head_ord")).agg(
        F.count("*").alias("n"), F.min("cell").cast("long").alias("first_cell")
    )


@query
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with time and size of their frame; every seventh frame is missing."""
    boxes = view(spark, d, "boxes")
    frames = boxes.select("frame_index").distinct().where("frame_index % 7 <> 3").withColumns({"ts_sec": F.col("frame_index") / 30.0, "width": F.lit(640), "height": F.lit(480)})
    return rounded(detection.annotated(boxes, frames, ["frame_index"]), "frame_ts").select("det_id", "frame_index", "frame_ts", "frame_width", "frame_height")


@query
def embedding_filter(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with an embedding that are large enough, once grown, to have one: 28 pixels here."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("det_id"), "embedding")
    boxes = view(spark, d, "boxes").join(v, "det_id", "left")
    return detection.recognised(detection.with_embedding(boxes, 640.0, 480.0, 28)).select("det_id", "frame_index")


@query
def nearest_identity(spark: SparkSession, d: str) -> DataFrame:
    """The identity of each observed box by the labelled boxes of the nearest sample time; object 5 has no label."""
    obs = view(spark, d, "obs").withColumn("ts", F.col("frame_index") / 30.0).withColumn("video", F.floor(F.col("frame_index") / 250))
    samples = obs.where("frame_index % 30 = 0").withColumn("cluster_id", F.when(F.col("obj_id") != 5, F.col("obj_id").cast("long")))
    return rounded(matching.nearest_labelled(obs.where("observed"), samples, ["video"]), "iou")


@query
def bracketing_frames(spark: SparkSession, d: str) -> DataFrame:
    """Of the frames that hold an object observed, the detection frames around each, among them."""
    frames = view(spark, d, "obs").where("observed").select("frame_index", "obj_id", F.floor(F.col("frame_index") / 250).alias("video"))
    return rounded(sampling.bracketed(frames, ["obj_id", "video"], 4), "t")


@query
def interpolate_detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes at a quarter, half or three quarters of the way, with frame and object of the nearer side."""
    obs = view(spark, d, "obs")
    matches = matching.in_turn(_steps(spark, d, 0.3), ["frame_index"], "det_a", "det_b", "iou").drop("frame_index")
    share = (F.col("det_a") % 3 + 1) / 4
    return rounded(matching.interpolate(matches, obs, obs, share, ("frame_index", "obj_id")), *CORNERS, "confidence")


@query
def largest_frame_faces(spark: SparkSession, d: str) -> DataFrame:
    boxes = view(spark, d, "obs").where("observed").withColumn("video", F.floor(F.col("frame_index") / 25))
    return identity.largest_frame(boxes, ["video"], "frame_index")


@query
def identity_previews(spark: SparkSession, d: str) -> DataFrame:
    """Each identity with the rectangle of its preview; one whose representative is unknown has none."""
    boxes = view(spark, d, "boxes")
    people = identity.summary(identity.by_position(boxes, [], "frame_index"), ["cluster_id"]).select(F.col("cluster_id").cast("long").alias("cluster_id"), "representative_det_id")
    out = identity.previews(people, boxes.where("det_id % 3 <> 0"), 640, 480)
    return out.select("cluster_id", "representative_det_id", *[F.col(f"preview.{c}").alias(c) for c in "xywh"])


@query
def expected_frames(spark: SparkSession, d: str) -> DataFrame:
    return sampling.expected_frames(view(spark, d, "videos")).select("id", "expected_frames")


@query
def frame_ordinals(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.ordinals(table(spark, d, "events"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", F.col("frame_index").cast("long").alias("frame_index"))


@query
def sampled_progress(spark: SparkSession, d: str) -> DataFrame:
    return sampling.every_nth(progress(spark, d), "event_id", 5).select("event_id", "phase")


@query
def running_faces(spark: SparkSession, d: str) -> DataFrame:
    """Observed boxes up to each frame of a video."""
    boxes = view(spark, d, "obs").where("observed").groupBy("frame_index").agg(F.count("*").alias("n"))
    return selection.running_totals(boxes.withColumn("video", F.floor(F.col("frame_index") / 250)), ["video"], "frame_index", F.col("n"))


@query
def loading_percent(spark: SparkSession, d: str) -> DataFrame:
    """Progress before each of a user's loads, in their order."""
    loads = table(spark, d, "events").select("user_id", "event_id")
    return rounded(selection.loading_percent(loads, ["user_id"], "event_id"), "loading_percent")


@query
def frame_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = progress(spark, d).select("event_id", "done", F.lit(900).alias("total"))
    return selection.frame_percent(rows).select("event_id", "percent")


@query
def phase_steps(spark: SparkSession, d: str) -> DataFrame:
    return progress(spark, d).select("event_id", selection.step_index(F.col("phase")).cast("long").alias("step"), naming.mebibytes(F.col("event_id") * 7919).alias("size"))


@query
def merged_progress(spark: SparkSession, d: str) -> DataFrame:
    """Each user's partial records folded into one."""
    return selection.merged(progress(spark, d), ["user_id"], "event_id", ["phase", "description", "done"])


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("user_id", "event_type")
    return e, selection.toggled(e, ["user_id"], "event_type").where("user_id % 2 = 0")


@query
def select_all(spark: SparkSession, d: str) -> DataFrame:
    """Everything chosen for even users, nothing for the others."""
    e, _ = _chosen(spark, d)
    return selection.everything(e.where("user_id % 2 = 0"), ["user_id"], "event_type").unionByName(selection.nothing(e.where("user_id % 2 = 1"), ["user_id"], "event_type"))


@query
def all_selected(spark: SparkSession, d: str) -> DataFrame:
    return selection.all_chosen(*_chosen(spark, d), ["user_id"], "event_type")


@query
def override_clear(spark: SparkSession, d: str) -> DataFrame:
    """Styles set since a user's last change of the global one, which is every 17th event."""
    e = table(spark, d, "events").withColumn("item", F.col("event_id") % 5)
    out = selection.overrides(e, ["user_id"], "item", "event_id", F.col("event_id") % 17 == 0)
    return out.select("user_id", "item", "event_id", F.col("event_type").alias("style"))


@query
def tracker_stream(spark: SparkSession, d: str) -> DataFrame:
    """`tracker_full` as a stream: a third of each video's frames arrive at a time, and the query stops and starts again in between; videos end with their 250th frame.

    Of a video that goes on, all frames but the newest. Detections, state and tracks are in the shared folder.
    """
    dets, scan, people = _faces(spark, d)
    folder = f"{shared_folder(spark)}/tracks-{uuid.uuid4().hex}"
    last = F.col("frame_index") % 250 == 249
    end = view(spark, d, "obs").where(last & (F.col("obj_id") == 0)).select(
        F.floor(F.col("frame_index") / 250).alias("video_id"), F.lit(-1).cast("long").alias("det_id"), "frame_index", *CORNERS, F.lit(None).cast("array<double>").alias("embedding"),
    )
    rows = dets.unionByName(end)
    for k in range(3):
        rows.where(F.floor(F.col("frame_index") % 250 / 84) == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = tracking_stream.track_stream(stream, scan, people).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(tracking.TRACK_SCHEMA).parquet(f"{folder}/out"), *CORNERS, digits=4)


def _recorded_as(frames: DataFrame) -> DataFrame:
    """Frames of recorded videos with the video's number and the value of their pixels."""
    return frames.withColumns({
        "video": F.regexp_extract("path", r"([0-9]+)\.y4m$", 1).cast("long"), "value": F.conv(F.hex(F.substring("rgba", 1, 1)), 16, 10).cast("long"),
    })


@query
def frames_by_range(spark: SparkSession, d: str) -> DataFrame:
    """All frames of uncompressed videos, recorded from the events, each file read by several tasks."""
    found = frame_files.read_frames(spark, recorded(spark, d), Y4M(), "*.y4m", range_bytes=32_768)
    return rounded(_recorded_as(found).select("video", "frame_index", "ts_sec", "width", "height", "value"), "ts_sec")


@query
def frames_at_samples(spark: SparkSession, d: str) -> DataFrame:
    """The frames of the recorded videos that are shown at 0.1 s and every second after it."""
    folder = recorded(spark, d)
    info = frame_files.video_info(spark.createDataFrame([(p,) for p, _ in frame_files.list_files(folder, "*.y4m")], "path string"), Y4M())
    times = sampling.sample_times(info.withColumn("id", F.col("path"))).select(F.col("id").alias("path"), "ts")
    return _recorded_as(frame_files.frames_at(times, Y4M(), span=5.0)).select("video", "frame_index", "value")


@query
def segments_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The recorded frames written by segments of 100 from the tasks that read them, and read back as the manifest has them."""
    out = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    found = frame_files.read_frames(spark, recorded(spark, d), Y4M(), "*.y4m", range_bytes=32_768)
    segment_files.write_segments(found, out, ["path"], size=100, arranged=True)
    return _recorded_as(segment_files.read_segments(spark, out)).select("video", "segment", "frame_index", "file_name", "value")


def spot_detector():
    """In place of a trained model: heads of bright cells, whose boxes are 72 pixels wide."""
    def heads(planes: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for stride in (8, 16, 32):
            n, side = len(planes), planes.shape[2] // stride
            bright = planes[:, 0].reshape(n, side, stride, side, stride).mean(axis=(2, 4), dtype=np.float64).reshape(n, -1) / 255
            size = np.full_like(bright, np.log(72 / stride))
            middle = np.full_like(bright, 0.5)
            out[stride] = np.stack([bright**2, np.where(bright > 0.6, 1.0, 0.0), middle, middle, size, size], axis=2)
        return out

    return heads


def spot_recogniser():
    """In place of a trained model: means of a face's quarters."""
    return lambda planes: planes.reshape(len(planes), 3, 2, 56, 2, 56).mean(axis=(3, 5), dtype=np.float64).reshape(len(planes), -1) + 0.01


@query
def scan_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The identities that the scan finds in videos recorded from the events, looked at every second as the reference does, with the size of their preview."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    paths = spark.createDataFrame([(p,) for p, _ in frame_files.list_files(recorded(spark, d, spots=True), "*.y4m")], "path string")
    found = scan_job.scan(spark, paths, Y4M(), spot_detector, spot_recogniser, folder)
    out = found["identities"].join(found["previews"].select("path", "cluster_id", "w", "h", F.octet_length("rgba").alias("bytes")), ["path", "cluster_id"], "left")
    out = out.withColumn("video", F.regexp_extract("path", r"([0-9]+)\.y4m$", 1).cast("long"))
    return rounded(out.select("video", "cluster_id", "face_count", "frame_index", "det_id", "best_confidence", "w", "h", "bytes"), "best_confidence")
