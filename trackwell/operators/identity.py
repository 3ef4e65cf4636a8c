"""Identities by position, their centroids and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwell.functions.vectors import normalized


def by_position(boxes: DataFrame, by: list[str], frame: str) -> DataFrame:
    """boxes with cluster_id: the place from the left within the frame, earlier det_id first on ties."""
    return boxes.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*by, frame).orderBy("x1", "det_id")) - 1)


def summary(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Of each identity: faces, and the most confident detection (the first on ties)."""
    best = F.max_by("det_id", F.struct("confidence", (-F.col("det_id")).alias("o")))
    return boxes.groupBy(*by).agg(F.count("*").alias("face_count"), best.alias("representative_det_id"), F.max("confidence").alias("best_confidence"))


def centroids(vectors: DataFrame, key: str, value: str = "embedding") -> DataFrame:
    """(key, embedding): the element-wise mean of each group's vectors, normalized. Means are combined before the shuffle."""
    parts = vectors.select(key, F.posexplode(value).alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return mean.select(key, normalized(F.col("mean")).alias("embedding"))


def largest_frame(boxes: DataFrame, by: list[str], frame: str) -> DataFrame:
    """The greatest number of faces in any frame of each group: as many identities there are."""
    return boxes.groupBy(*by, frame).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("most"))


def previews(identities: DataFrame, boxes: DataFrame, width: float, height: float) -> DataFrame:
    """identities(representative_det_id) with the rectangle to cut their preview from; null where it has no area or the box is missing."""
    low, high = (lambda c: F.greatest(F.lit(0.0), F.floor(c))), (lambda c, most: F.least(F.lit(float(most)), F.ceil(c)))
    rect = F.struct(low("x1").alias("x"), low("y1").alias("y"), (high("x2", width) - low("x1")).alias("w"), (high("y2", height) - low("y1")).alias("h"))
    own = boxes.select(F.col("det_id").alias("representative_det_id"), F.when((rect["w"] > 0) & (rect["h"] > 0), rect).alias("preview"))
    return identities.join(own, "representative_det_id", "left")
