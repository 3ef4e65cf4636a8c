"""Greedy choices as rounds of local best ones over an edge table, for groups too large to be collected."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.functions.geometry import CORNERS, pixel_iou
from trackwell.operators.matching import spread_by_cell
from trackwell.plans.views import shared_folder

#: Rounds after which a chain of choices that each wait for the one before is given up with an error.
MOST_ROUNDS = 10_000


class _Tables:
    """Tables written in the shared folder, one a round; a round's table goes when the next one stands."""

    def __init__(self, spark, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._path = path
        return out

    def drop(self, frame: DataFrame) -> None:
        """Deletes the table of a round that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(frame._path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def suppress_crowded(boxes: DataFrame, by: list[str], threshold: float, cell: int = 128) -> DataFrame:
    """The result of `detection.suppress` for frames of any number of boxes, det_id unique in its group: no frame is collected.

    Boxes that overlap too much meet by grid cell and become edges, from the better box (more confident, then smaller det_id) to the worse one.
    In each round, boxes without a better neighbour that is still open stay, and their neighbours go: the greedy choice itself, found from many
    places at once. Rounds end when no edge is left; there are as many as the longest chain of boxes that wait for each
    other, few where overlaps are local. Boxes with a null corner or a null group
    overlap nothing and stay.
    """
    own = boxes.select(*by, "det_id", *CORNERS, "confidence")
    tables = _Tables(boxes.sparkSession, "suppress")
    rank = lambda side: F.struct((-F.col(f"{side}.confidence")).alias("order"), F.col(f"{side}.det_id").alias("det_id"))
    met = spread_by_cell(own, by, "a", cell, ("confidence",), 1.0).join(spread_by_cell(own, by, "b", cell, ("confidence",), 1.0), [*by, "cx", "cy"])
    first = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell)
    same = (F.col("cx") == first("x1")) & (F.col("cy") == first("y1"))
    edges = met.where(same & (rank("a") < rank("b"))).where(pixel_iou(F.col("a"), F.col("b")) > threshold)
    open_ = tables.save(edges.select(*by, F.col("a.det_id").alias("better"), F.col("b.det_id").alias("worse")))
    gone = None
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        waiting = open_.select(*by, F.col("worse").alias("better")).distinct()
        stay = open_.select(*by, "better").distinct().join(waiting, [*by, "better"], "left_anti")
        beaten = tables.save(open_.join(stay, [*by, "better"], "left_semi").select(*by, "worse").distinct())
        gone = beaten if gone is None else gone.unionByName(beaten)
        rest = open_.join(beaten, [*by, "worse"], "left_anti").join(beaten.withColumnRenamed("worse", "better"), [*by, "better"], "left_anti")
        before, open_ = open_, tables.save(rest)
        tables.drop(before)
    else:
        raise RuntimeError("suppression did not end")
    out = own if gone is None else own.join(gone.withColumnRenamed("worse", "det_id"), [*by, "det_id"], "left_anti")
    return out.select("det_id", *by, *CORNERS, "confidence")


def greedy_crowded(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """The result of `matching.greedy`, (left, right) unique in its group, for groups of any number of pairs: no group is collected.

    In each round, pairs that are the best open ones of both their sides are chosen, and all pairs of those sides go: what
    the greedy choice by falling score, then left, then right takes in the end. Rows with a null group, left or right are left out.
    """
    tables = _Tables(pairs.sparkSession, "greedy")
    order = F.struct((-F.col(score)).alias("order"), F.col("l"), F.col("r"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, left, right)])
    open_ = tables.save(pairs.where(whole).select(*by, F.col(left).alias("l"), F.col(right).alias("r"), F.col(score)))
    chosen = pairs.where("false").select(*by, F.col(left).alias("l"), F.col(right).alias("r"), F.col(score))
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        best = lambda side: open_.groupBy(*by, side).agg(F.min(order).alias("best")).select(*by, "best.l", "best.r")
        taken = tables.save(best("l").join(best("r"), [*by, "l", "r"]).join(open_, [*by, "l", "r"]).select(open_.columns))
        chosen = chosen.unionByName(taken)
        rest = open_.join(taken.select(*by, "l"), [*by, "l"], "left_anti").join(taken.select(*by, "r"), [*by, "r"], "left_anti")
        before, open_ = open_, tables.save(rest)
        tables.drop(before)
    else:
        raise RuntimeError("the choice did not end")
    return chosen.select(*by, F.col("l").alias(left), F.col("r").alias(right), score)
