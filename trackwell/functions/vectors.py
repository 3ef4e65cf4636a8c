"""Vector functions on array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Plain dot product: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, least: float = 1e-12) -> Column:
    """v over its norm; unchanged where the norm is below `least`."""
    return F.transform(v, lambda x: F.when(norm(v) < least, x.cast("double")).otherwise(x.cast("double") / norm(v)))
