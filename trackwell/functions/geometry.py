"""Box geometry as column expressions. A box is any struct column with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def box(*extra: str) -> Column:
    return F.struct(*CORNERS, *extra)


def clamp(v: Column, low, high) -> Column:
    """v within [low, high]; NaN passes through (Spark orders it above all numbers)."""
    return F.when(F.isnan(v), v).when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)


def half_up(v: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(v + 0.5).cast("double")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of continuous boxes; 0 where they don't overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(F.try_divide(w * h, area(a) + area(b) - w * h))


def pixel_iou(a: Column, b: Column) -> Column:
    """Intersection over union where both edges of a box count as pixels, so every extent is one more."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1)
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1)
    area = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
    return w * h / (area(a) + area(b) - w * h)


def expanded(ratio: float, width: float, height: float) -> dict[str, Column]:
    """Corners grown by `ratio` of the size on each side, rounded, within the frame."""
    dx, dy = (F.col("x2") - F.col("x1")) * ratio, (F.col("y2") - F.col("y1")) * ratio
    return {
        "x1": F.greatest(F.lit(0.0), half_up(F.col("x1") - dx)), "y1": F.greatest(F.lit(0.0), half_up(F.col("y1") - dy)),
        "x2": F.least(F.lit(width), half_up(F.col("x2") + dx)), "y2": F.least(F.lit(height), half_up(F.col("y2") + dy)),
    }


def letterbox(width: Column, height: Column, target: int) -> Column:
    """scale, new size and padding that fit a frame into a square."""
    scale = F.least(F.lit(target) / width, F.lit(target) / height)
    w, h = half_up(width * scale), half_up(height * scale)
    return F.struct(
        scale.alias("scale"), w.alias("new_width"), h.alias("new_height"),
        F.floor((F.lit(target) - w) / 2).alias("pad_x"), F.floor((F.lit(target) - h) / 2).alias("pad_y"),
    )


def between(a: Column, b: Column, t: Column) -> list[Column]:
    """Corners and confidence at share t of the way from a to b."""
    return [(a[c] + (b[c] - a[c]) * t).alias(c) for c in (*CORNERS, "confidence")]
