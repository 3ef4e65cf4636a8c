"""From detector heads to detections: decoding, score and shape filters, overlap suppression, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwell.functions.geometry import CORNERS, expanded, pixel_iou

#: Fixed values of the detector.
SCORE, OVERLAP, TOP_K, INPUT = 0.3, 0.35, 5000, 640


def decode_anchors(heads: DataFrame, scale: float = 1.0, width: float = INPUT, height: float = INPUT, score: float = SCORE) -> DataFrame:
    """Head rows (stride, cell, cls, obj, dx, dy, dw, dh) -> the same rows with a box and its confidence, weak ones left out."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    columns = F.floor(F.lit(INPUT) / F.col("stride"))
    x, y = F.pmod("cell", columns), F.floor(F.col("cell") / columns)
    cx, cy = (x + F.col("dx")) * F.col("stride"), (y + F.col("dy")) * F.col("stride")
    w, h = F.exp("dw") * F.col("stride"), F.exp("dh") * F.col("stride")
    within = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v / scale))
    return heads.withColumn("confidence", F.sqrt(unit("cls") * unit("obj"))).where(
        ~F.isnan("confidence") & (F.col("confidence") >= score)
    ).withColumns({
        "x1": within(cx - w / 2, width), "y1": within(cy - h / 2, height), "x2": within(cx + w / 2, width), "y2": within(cy + h / 2, height),
    })


def shape_filter(boxes: DataFrame, least: float = 10, narrow: float = 0.4, wide: float = 2.5) -> DataFrame:
    """Boxes of at least `least` pixels each way whose aspect lies strictly between the limits."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where((w >= least) & (h >= least) & (w > h * narrow) & (w < h * wide))


def suppress(boxes: DataFrame, by: list[str], threshold: float = OVERLAP) -> DataFrame:
    """Greedy suppression within each group of `by`: by falling confidence, then det_id, a box stays unless one that stays overlaps it more.

    One aggregation brings a group together; groups are frames, so their size is what a
    detector reports for one image.
    """
    own = F.struct((-F.col("confidence")).alias("order"), "det_id", *CORNERS)
    kept = F.aggregate(
        F.sort_array(F.collect_list(own)), F.slice(F.collect_list(own), 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: pixel_iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))),
    )
    out = boxes.groupBy(*by).agg(kept.alias("kept")).select(*by, F.explode("kept").alias("b"))
    return out.select("b.det_id", *by, *[f"b.{c}" for c in CORNERS], (-F.col("b.order")).alias("confidence"))


def heads(tables: list[DataFrame]) -> DataFrame:
    """Head tables of all strides as one, with head_ord, their order, which decides between equal scores before the cell does."""
    out = tables[0].withColumn("head_ord", F.lit(0))
    for n, more in enumerate(tables[1:], 1):
        out = out.unionByName(more.withColumn("head_ord", F.lit(n)))
    return out


def detect(rows: DataFrame, by: list[str], width: float = INPUT, height: float = INPUT, scale: float = 1.0, k: int = TOP_K) -> DataFrame:
    """Head rows with a det_id -> detections: weak ones go, then overlapped ones, then those of odd shape, and of the rest the k best of each frame stay."""
    return top_k(shape_filter(suppress(decode_anchors(rows, scale, width, height), by)), by, k)


def annotated(boxes: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """boxes with the time and size of their frame: an equi-join on the frame's key; boxes of unknown frames go."""
    return boxes.join(frames.select(*by, F.col("ts_sec").alias("frame_ts"), F.col("width").alias("frame_width"), F.col("height").alias("frame_height")), by)


def with_embedding(boxes: DataFrame, width: float, height: float, least: float = 10) -> DataFrame:
    """The embedding becomes null where the grown box is too small to be recognised."""
    grown = expanded(0.2, width, height)
    small = (grown["x2"] - grown["x1"] < least) | (grown["y2"] - grown["y1"] < least)
    return boxes.withColumn("embedding", F.when(~small, F.col("embedding")))


def recognised(boxes: DataFrame) -> DataFrame:
    """Boxes that have an embedding."""
    return boxes.where("embedding is not null")


def top_k(boxes: DataFrame, by: list[str], k: int = TOP_K) -> DataFrame:
    """The k most confident boxes of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("confidence"), "det_id")
    return boxes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
