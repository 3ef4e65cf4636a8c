"""What is redacted and where: regions by style, block means, frames with their regions drawn."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.functions import pixels
from trackwell.functions.geometry import half_up
from trackwell.functions.pixels import BLOCK
from trackwell.functions.pixels import redacted as redact_pixels  # noqa: F401


def _region(box, width: Column, height: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a box is large enough once it is cut to its frame, and the rectangle to draw; box(name) gives a corner or the style."""
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(most, box(c)))
    x, y, w, h = clip("x1", width), clip("y1", height), clip("x2", width) - clip("x1", width), clip("y2", height) - clip("y1", height)
    bar, fine = box("style") == "eye-bar", box("style") == "eye-bar-fine"
    pick = lambda a, b, rest: F.when(bar, a).when(fine, b).otherwise(rest)
    tall = pick(F.greatest(F.lit(10.0), h * 0.2), F.greatest(F.lit(6.0), h * 0.12), half_up(h))
    return (w >= 2) & (h >= 2), {
        "rx": pick(x + w * 0.05, x + w * 0.075, half_up(x)), "ry": pick(y + h * 0.22, y + h * 0.28, half_up(y)), "rw": pick(w * 0.9, w * 0.85, half_up(w)), "rh": tall,
        "radius": pick(F.least(F.lit(4.0), tall / 2), F.least(F.lit(3.0), tall / 2), F.lit(0.0)),
    }


def regions(boxes: DataFrame, width: float | Column, height: float | Column) -> DataFrame:
    """boxes(…, style) with the rectangle to draw (rx, ry, rw, rh) and the corner radius; boxes under two pixels go.

    Styles: pixelate, black-box (the whole box), eye-bar, and eye-bar-fine, a thinner bar
    somewhat lower.
    """
    most = [c if isinstance(c, Column) else F.lit(float(c)) for c in (width, height)]
    large, drawn = _region(F.col, *most)
    return boxes.where(large).withColumns(drawn)


def block_means(values: DataFrame, x: Column, y: Column, channels: list[str], block: int = BLOCK) -> DataFrame:
    """Mean of each channel over square blocks; those at the edges are smaller."""
    return values.groupBy(F.floor(x / block).alias("bx"), F.floor(y / block).alias("by")).agg(*[F.avg(c).alias(c) for c in channels], F.count("*").alias("n"))


def _draw(block: int):
    """A function of frames and their regions: pixels with every region drawn in turn."""

    @F.arrow_udf("binary")
    def draw(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rgba, width, height, own in batches:
            out = []
            for data, w, h, boxes in zip(rgba, width.to_pylist(), height.to_pylist(), own.to_pylist()):
                if not boxes or not data.is_valid:
                    out.append(data.as_py())
                    continue
                image = pixels.frame(data.as_py(), w, h)
                for r in boxes:
                    image = pixels.redacted(image, r["style"], r["rx"], r["ry"], r["rw"], r["rh"], r["radius"], block)
                out.append(image.tobytes())
            yield pa.array(out, pa.binary())

    return draw


def redact_frames(frames: DataFrame, targets: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """frames(by, width, height, rgba) with every region of targets(by, ord, style, corners) drawn in turn, by rising ord, over what was drawn before.

    Boxes are cut to their own frame, and go if under two pixels; a frame without targets stays as it is. Frames meet their targets
    in a join, one list of boxes for each frame: where the lists are too large to be broadcast, frames are exchanged.
    `redact_in_place` never moves them.
    """
    size = {c: F.col(f"_{c}") for c in ("width", "height")}
    sized = targets.join(frames.select(*by, *[F.col(c).alias(f"_{c}") for c in size]), by)
    regions_of = regions(sized, size["width"], size["height"])
    lists = regions_of.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "style", "rx", "ry", "rw", "rh", "radius"))).alias("_regions"))
    return frames.join(lists, by, "left").withColumn("rgba", _draw(block)("rgba", "width", "height", "_regions")).drop("_regions")


def lay_out(frames: DataFrame, table: str, video: str, buckets: int, span: int = 300, mode: str = "error") -> DataFrame:
    """Writes frames(video, frame_index, ...) as a table bucketed by video and range of `span` frames, and returns it.

    Frames aren't exchanged: each task writes a file to each bucket that its ranges belong to, few where tasks hold runs of frames, as those of
    a frame source do. Ranges, not videos, are dealt to buckets, so a long video spreads over them.
    """
    ranged = frames.withColumn("range", F.floor(F.col("frame_index") / span).cast("long"))
    ranged.write.bucketBy(buckets, video, "range").option("span", str(span)).mode(mode).saveAsTable(table)
    return frames.sparkSession.table(table)


def redact_in_place(frames: DataFrame, targets: DataFrame, video: str, span: int = 300, block: int = BLOCK) -> DataFrame:
    """`redact_frames` for frames that `lay_out` has written with the same span: targets(video, frame_index, ord, style, corners) go to the buckets, pixels stay.

    Targets come as one list for each range of frames, so that they join by the columns that the table is bucketed by; each frame then takes its own,
    cut to its size. Lists are hashed, so that pixels aren't sorted either. Null videos have no targets.
    """
    box = F.struct("frame_index", "ord", "style", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    lists = targets.withColumn("range", F.floor(F.col("frame_index") / span).cast("long")).groupBy(video, "range").agg(F.collect_list(box).alias("_boxes"))
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    own = F.filter("_boxes", lambda b: (b["frame_index"] == F.col("frame_index")) & _region(lambda c: b[c], width, height)[0])
    drawn = F.transform(F.sort_array(own), lambda b: F.struct(b["style"].alias("style"), *[c.alias(n) for n, c in _region(lambda c: b[c], width, height)[1].items()]))
    joined = frames.join(lists.hint("shuffle_hash"), [video, "range"], "left")
    return joined.withColumn("rgba", _draw(block)("rgba", "width", "height", drawn)).select(*frames.columns)


def styles(targets: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    """targets(cluster_id) with the style of their override, or the default one."""
    return targets.join(overrides, "cluster_id", "left").withColumn("style", F.coalesce("style", F.lit(default)))
