"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_name(ordinal: Column) -> Column:
    """frame_0001.jpg and so on; numbers beyond four digits keep all of them."""
    return F.format_string("frame_%04d.jpg", ordinal)


def output_name(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("video.mp4")), r"\.[A-Za-z0-9_]+$", "_blurred.mp4")


def phase_label(phase: Column) -> Column:
    return F.replace(phase, F.lit("-"), F.lit(" "))


def mebibytes(size: Column, digits: int = 1) -> Column:
    """A size in bytes as MiB with that many digits, 6 at most; a size halfway between two goes to the even one, as in C's printf."""
    exact = size.cast("decimal(30,10)") / F.lit(1 << 20).cast("decimal(7,0)")  # 18 decimals: none but a half looks like one
    return F.bround(exact, digits).cast("string")
