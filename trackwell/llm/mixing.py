"""Mixing sources to target weights: a splitting tree deals exact block quotas to output shards, which draw permuted blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from trackwell.llm.common import WORD, Scratch, free_name

#: Sources that one mix may have: weights are a list that somebody writes, so one row each may pass through the driver.
MAX_SOURCES = 65_536


def targets(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of `total` by weight; none above `most` times its size, the excess reshared by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


class SplittingTree:
    """Deals blocks of each source to shards: every shard gets its exact number of blocks, in multivariate hypergeometric counts.

    A node stands for a range of shards and holds a quota of blocks for each source. Its left
    half draws, without replacement, as many blocks as its shards hold; the right half gets
    the rest. Draws depend on the seed and the node alone, so any task can walk from the root
    to the shard of a block, and a rerun agrees. Only the nodes on the way are held.
    """

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.asarray(quotas, dtype=np.int64), shards, seed
        self.total = int(self.quotas.sum())

    def blocks_before(self, shard: int) -> int:
        return self.total * shard // self.shards

    def _left_quota(self, lo: int, hi: int, quota: np.ndarray) -> np.ndarray:
        mid = (lo + hi) // 2
        draw = self.blocks_before(mid) - self.blocks_before(lo)
        rng = np.random.default_rng([self.seed, lo, hi])
        return rng.multivariate_hypergeometric(quota, draw, method="marginals").astype(np.int64)

    def place(self, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The shard of each (source, rank among its source's permuted blocks)."""
        out = np.zeros(len(rank), dtype=np.int64)
        stack = [(0, self.shards, self.quotas, np.arange(len(rank)), rank.copy())]
        while stack:
            lo, hi, quota, rows, at = stack.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid, left = (lo + hi) // 2, self._left_quota(lo, hi, quota)
            here = at < left[source[rows]]
            stack.append((lo, mid, left, rows[here], at[here]))
            stack.append((mid, hi, quota - left, rows[~here], at[~here] - left[source[rows[~here]]]))
        return out


def _permuted(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks(index, bits, block, words) with rank and start: blocks and words before each in a hashed order of its source's blocks.

    Sums run in two levels, groups of blocks and blocks in a group, so that no task holds all blocks of a large source.
    """
    keyed = blocks.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "index", "block"), 4))
    keyed = keyed.withColumn("group", F.expr("`key` >> cast(60 - `bits` div 2 as int)"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    groups = keyed.groupBy("index", "group").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    outer = before(["index"], ["group"])
    groups = groups.select("index", "group", earlier("n", outer).alias("n"), earlier("w", outer).alias("w"))
    inner = before(["index", "group"], ["key", "block"])
    return keyed.join(groups, ["index", "group"]).select(
        "index", "block", "words", (F.col("n") + F.coalesce(F.count("*").over(inner), F.lit(0))).alias("rank"), (F.col("w") + earlier("words", inner)).alias("start"),
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7,
    block_words: int = 16_384, shard_words: int = 4_194_304, scratch: Scratch | None = None,
) -> DataFrame:
    """docs with a struct column `mix`: size, source_size (longs), target (double), draws (array of struct(pass, shard, place)).

    size is the number of words of the text (null: 0). Sources in code-point order, the null
    source last, get the weights in turn. A hash deals the documents of a source in blocks of
    about block_words (more where there would be over 2^28 blocks in all), and another hash permutes the blocks. A source's quota
    is the number of blocks that its target asks for, in the permuted order: all of them in each full
    pass, then the first ones. The splitting tree deals the quotas to shards of about
    shard_words, each shard draws the next of the permuted blocks that it was dealt, and the documents of
    those blocks are taken. Of the block at which a source's target falls, the documents that still fit, in the hashed order,
    are, and the one of the others that fills the gap best, so the words taken miss the target by less than half of the smallest document left out. `place` is a random
    order within the shard. No row is drawn more than `most` times (rounded up). Documents
    without words are never drawn. Rows alike in id, source and text are drawn alike, so reruns agree. An empty table gives an empty result.

    Words are counted into a table without texts, and once more where the documents are put out; texts are never shuffled unless the table of
    blocks is too large to be broadcast. Only one row for each source goes to the driver; more than
    MAX_SOURCES sources are refused.
    """
    spark, name = docs.sparkSession, free_name(docs, "mix")
    scratch = scratch or Scratch(spark, "mix")
    size, order, index, bits, key, block, draws, whole, target = (
        free_name(docs, f"_{x}") for x in ("size", "order", "index", "bits", "source", "block", "draws", "whole", "target")
    )
    counted = {
        size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        order: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.col("source"), "text"), 4),
    }
    sizes_of = scratch.save(docs.select("source", *[c.alias(n) for n, c in zip(("size", "order"), counted.values())]))
    found = sizes_of.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["words"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], sum(sizes), most)
    while sum(goal) / block_words > 2**28:
        block_words *= 2
    rows = []
    for i, (r, g) in enumerate(zip(found, goal)):
        full = int(g / r["words"] + 1e-9) if r["words"] else 0
        rows.append((r["source"], i, (r["words"] // block_words).bit_length(), r["words"], g, full, max(0.0, g - full * r["words"])))
    plan = spark.createDataFrame(rows, T.StructType([
        T.StructField("name", docs.schema["source"].dataType),
        *[T.StructField(n, T.DoubleType() if n in ("target", "rest") else T.LongType()) for n in ("index", "bits", "whole", "target", "full", "rest")],
    ]))
    in_block = lambda o, b: F.expr(f"`{o}` >> cast(60 - `{b}` as int)")
    with_plan = sizes_of.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name")))
    blocks = with_plan.withColumn("block", in_block("order", "bits")).groupBy("index", "bits", "block").agg(F.sum("size").alias("words"))
    ranked = scratch.save(_permuted(blocks, seed).join(F.broadcast(plan.select("index", "full", "rest")), "index"))
    used = F.when(F.col("start") < F.col("rest"), F.lit(1)).otherwise(F.lit(0))
    quotas = [0] * len(rows)
    many = [0] * len(rows)
    for r in ranked.groupBy("index").agg(F.sum(F.col("full") + used).alias("quota"), F.count("*").alias("n")).collect():
        quotas[r["index"]], many[r["index"]] = r["quota"], r["n"]
    shards = max(1, min(sum(quotas), round(sum(goal) / shard_words)))
    tree = SplittingTree(quotas, shards, seed)

    @arrow_udf("long")
    def shard_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for source, rank in batches:
            yield pa.array(tree.place(source.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)))

    in_all = spark.createDataFrame(list(enumerate(many)), "index long, blocks long")
    cut = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest"))
    passes = ranked.where(F.col("full") + used > 0).join(F.broadcast(in_all), "index").select(
        "index", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") + used - 1)).alias("pass"), "full", (F.col("rest") - F.col("start")).alias("left"), cut.alias("cut"), "rank", "blocks",
    )
    dealt = scratch.save(passes.select(
        "index", "block", "pass", shard_of("index", F.col("pass") * F.col("blocks") + F.col("rank")).alias("shard"),
        (F.col("cut") & (F.col("pass") == F.col("full"))).alias("cut"), "left",
    ))
    # Of the one block of a source at which its target falls: the documents, by their place in the hashed order, that fit one after the other, and then the one that fills the gap best.
    ends = dealt.where("cut").select("index", "block", "left")
    edge = with_plan.where(F.col("size") > 0).withColumn("block", in_block("order", "bits")).join(F.broadcast(ends), ["index", "block"])
    listed = edge.groupBy("index", "left", "order").agg(F.sum("size").alias("size")).groupBy("index", "left").agg(F.sort_array(F.collect_list(F.struct("order", "size"))).alias("docs"))
    none = F.struct(F.lit(0).cast("long").alias("words"), F.array().cast("array<bigint>").alias("orders"))
    filled = F.aggregate("docs", none, lambda held, d: F.when(held["words"] + d["size"] <= F.col("left"), F.struct(
        (held["words"] + d["size"]).alias("words"), F.concat(held["orders"], F.array(d["order"])).alias("orders"),
    )).otherwise(held))
    listed = listed.withColumn("held", filled).withColumn("gap", F.col("left") - F.col("held.words"))
    missed = lambda d: F.struct(F.abs(F.col("gap") - d["size"]).alias("missed"), d["order"].alias("order"))
    open_ = F.filter("docs", lambda d: ~F.array_contains("held.orders", d["order"]) & (F.abs(F.col("gap") - d["size"]) < F.col("gap")))
    extra = F.array_min(F.transform(open_, missed))["order"]
    edges = scratch.save(listed.select("index", F.array_compact(F.concat("held.orders", F.array(extra))).alias("taken")))
    of_block = dealt.join(F.broadcast(edges), "index", "left").groupBy("index", "block").agg(F.sort_array(F.collect_list(F.struct(
        "pass", "shard", F.when(F.col("cut"), F.coalesce("taken", F.array().cast("array<bigint>"))).alias("only"),
    ))).alias("passes"))
    mine = of_block.select(F.col("index").alias(index), F.col("block").alias(block), F.col("passes").alias(draws))
    own = plan.select(*[F.col(a).alias(b) for a, b in (("name", key), ("index", index), ("bits", bits), ("whole", whole), ("target", target))])
    out = docs.withColumns(counted).join(F.broadcast(own), F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    out = out.withColumn(block, in_block(order, bits)).join(mine, [index, block], "left")
    passes = F.coalesce(F.col(draws), F.array().cast("array<struct<pass:bigint,shard:bigint,only:array<bigint>>>"))
    taken = F.filter(passes, lambda x: (F.col(size) > 0) & (x["only"].isNull() | F.array_contains(x["only"], F.col(order))))
    drawn = F.transform(taken, lambda x: F.struct(
        x["pass"].alias("pass"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), x["pass"], x["shard"], F.col(order)).alias("place")
    ))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.col(size).alias("size"), F.col(whole).alias("source_size"), F.col(target).alias("target"), drawn.alias("draws"),
    ).alias(name))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: docs' columns, one row for each draw, and `shard`, `place`, `pass` (renamed with underscores on a clash)."""
    name, draw = free_name(docs, "mix"), free_name(docs, "_draw")
    out = mix(docs, **options).withColumn(draw, F.explode(f"{name}.draws"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{draw}.{c}").alias(free_name(docs, c)) for c in ("shard", "place", "pass")])


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the mixture by shard, each shuffled within itself; documents move to their shard once."""
    out = mixture(docs, **options)
    shard, place = out.columns[-3:-1]
    out.repartition(F.col(shard)).sortWithinPartitions(shard, place).write.partitionBy(shard).parquet(path)


def words_taken(mixed: Column) -> Column:
    return mixed["size"] * F.size(mixed["draws"])
