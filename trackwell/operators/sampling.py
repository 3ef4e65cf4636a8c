"""Times and ordinals of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_times(videos: DataFrame, fps: float = 1.0) -> DataFrame:
    """videos(duration) exploded to sample times: 0.1, then one each 1/fps, while under duration - 0.1."""
    n = F.ceil((F.col("duration") - 0.2) * fps - 1e-9)
    times = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: k / fps + 0.1))
    return videos.withColumn("ts", F.explode(times)).where(F.col("ts") < F.col("duration") - 0.1)


def frame_times(videos: DataFrame) -> DataFrame:
    """videos(duration, fps) exploded to (frame_index, ts), ts = index / fps and at most duration - 0.001."""
    n = F.ceil(F.col("duration") * F.col("fps"))
    out = videos.withColumn("frame_index", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    return out.withColumn("ts", F.least(F.col("frame_index") / F.col("fps"), F.col("duration") - 0.001))


def stride(frames: DataFrame, every: int = 2) -> DataFrame:
    """The frames on which the detector runs."""
    return frames.where(F.pmod("frame_index", F.lit(every)) == 0)


def segments(frames: DataFrame, by: list[str], size: int = 300) -> DataFrame:
    """First and last ordinal (from 1) of each encoding segment."""
    n = F.col("frame_index") + 1
    return frames.groupBy(*by, F.floor((n - 1) / size).alias("segment")).agg(F.min(n).alias("first"), F.max(n).alias("last"))


def actual_rate(chunks: DataFrame, by: list[str], duration: str) -> DataFrame:
    """Frames, keyframes and frames a second of each video; null where either is missing."""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if("is_key").alias("keyframes"),
        F.when(F.max(duration) > 0, F.try_divide(F.count("*").cast("double"), F.max(duration))).alias("fps"),
    )


def expected_frames(videos: DataFrame) -> DataFrame:
    """videos(duration, fps) with the number of frames to expect."""
    return videos.withColumn("expected_frames", F.ceil(F.col("duration") * F.col("fps")))


def ordinals(frames: DataFrame, by: list[str], time: str) -> DataFrame:
    """Frames numbered from 0 by time within each video."""
    return frames.withColumn("frame_index", F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1)


def bracketed(frames: DataFrame, by: list[str], every: int = 2) -> DataFrame:
    """Each frame with the detection frames around it and its share of the way: (prev_index, next_index, t); one on a detection frame is its own neighbour.

    Detection frames are those at multiples of `every` that the table holds. Two running windows; null where one side is missing.
    """
    mark = F.when(F.pmod("frame_index", F.lit(every)) == 0, F.col("frame_index"))
    order = Window.partitionBy(*by)
    out = frames.withColumns({
        "prev_index": F.last(mark, ignorenulls=True).over(order.orderBy("frame_index")),
        "next_index": F.last(mark, ignorenulls=True).over(order.orderBy(F.desc("frame_index"))),
    })
    gap = F.col("next_index") - F.col("prev_index")
    return out.withColumn("t", F.when(gap > 0, (F.col("frame_index") - F.col("prev_index")) / gap).when(gap == 0, F.lit(0.0)))


def every_nth(events: DataFrame, ordinal: str, n: int = 10) -> DataFrame:
    """The rows at which progress is told."""
    return events.where(F.pmod(ordinal, F.lit(n)) == 0)
