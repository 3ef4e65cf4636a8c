"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch, free_name


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs -> (node, root), root being the smallest node of the component; nodes without an edge are absent.

    Every step is one aggregation (minimum neighbour, combined before the shuffle) and one
    equi-join of unique minima with the edges, which AQE may split where a node is hot. Each
    round is written to the shared scratch folder, so a lost executor costs one round.
    Self-loops and repeated edges are allowed. An empty edge table gives an empty result.
    """
    now = scratch.save(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    before = _signature(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large = scratch.save(_large_star(now))
        small = scratch.save(_small_star(large))
        scratch.drop(now, large)
        now, after = small, _signature(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of each component; grouped: doc_id, th (xxhash64 of the text) and root of every row.

    That with the smallest doc_id stays, null ids last, and of rows with one id that with the
    smallest hash of its text; of rows alike in both, any one. An id that stands for unlike texts
    keeps a row in each of their components.
    """
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("x"))
    kept, own, text = (free_name(docs, n) for n in ("_kept_id", "_kept_text", "_text_hash"))
    first = least.select(F.col("x.doc_id").alias(kept), F.col("x.th").alias(own))
    hashed = docs.withColumn(text, F.xxhash64("text"))
    stay = hashed.join(first, F.col("doc_id").eqNullSafe(F.col(kept)) & (F.col(text) == F.col(own)), "left_semi")
    return stay.dropDuplicates(["doc_id", text]).drop(text)
