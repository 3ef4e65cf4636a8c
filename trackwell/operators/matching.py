"""Matching boxes and vectors: overlap joins, greedy, sequential, nearest in time and optimal."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.functions.geometry import CORNERS, between, iou
from trackwell.functions.vectors import dot
from trackwell.plans.views import shared_folder
from trackwell.sources.frames import store_of

#: Vectors of one block whose products with the other block are made at once.
STRIP = 512


def overlap_pairs(a: DataFrame, b: DataFrame, by: list[str], least: float = 0.0) -> DataFrame:
    """Pairs (det_a, det_b, iou) of the same group whose overlap exceeds `least`: an equi-join on the group, overlap as residual."""
    left = a.select(*by, F.struct("det_id", *CORNERS).alias("a"))
    right = b.select(*by, F.struct("det_id", *CORNERS).alias("b"))
    return left.join(right, by).select(
        *by, F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), iou(F.col("a"), F.col("b")).alias("iou")
    ).where(F.col("iou") > least)


def spread_by_cell(boxes: DataFrame, by: list[str], name: str, cell: int, more: tuple[str, ...] = (), margin: float = 0.0) -> DataFrame:
    """boxes as a struct `name`, once for each grid cell (cx, cy) that they, grown by a margin at their far edges, touch."""
    index = lambda c: F.floor(c / cell)
    return (
        boxes.select(*by, F.struct("det_id", *CORNERS, *more).alias(name), F.explode(F.sequence(index(F.col("x1")), index(F.col("x2") + margin))).alias("cx"), index(F.col("y1")).alias("t"), index(F.col("y2") + margin).alias("e"))
        .select(*by, name, "cx", F.explode(F.sequence("t", "e")).alias("cy"))
    )


def overlap_pairs_by_cell(a: DataFrame, b: DataFrame, by: list[str], least: float = 0.0, cell: int = 128) -> DataFrame:
    """The same pairs for crowded groups: boxes meet by grid cell, and count in the cell where their intersection begins."""
    first = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell)
    return spread_by_cell(a, by, "a", cell).join(spread_by_cell(b, by, "b", cell), [*by, "cx", "cy"]).where((F.col("cx") == first("x1")) & (F.col("cy") == first("y1"))).select(
        *by, F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), iou(F.col("a"), F.col("b")).alias("iou")
    ).where(F.col("iou") > least)


def greedy(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one choice in each group by falling score, then left, then right."""
    own = F.struct((-F.col(score)).alias("order"), F.col(left).alias("l"), F.col(right).alias("r"))
    chosen = F.aggregate(
        F.sort_array(F.collect_list(own)), F.slice(F.collect_list(own), 1, 0),
        lambda done, p: F.when(F.exists(done, lambda d: (d["l"] == p["l"]) | (d["r"] == p["r"])), done).otherwise(F.concat(done, F.array(p))),
    )
    return pairs.groupBy(*by).agg(chosen.alias("m")).select(*by, F.explode("m").alias("m")).select(
        *by, F.col("m.l").alias(left), F.col("m.r").alias(right), (-F.col("m.order")).alias(score)
    )


def in_turn(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """Each left item, in order, takes its best right item that is still free; the earlier one wins ties."""
    lists = pairs.groupBy(*by, left).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("order"), F.col(right).alias("r")))).alias("c"))
    turn = F.struct(F.col(left).alias("l"), "c")
    empty = F.array().cast("array<struct<l:bigint,r:bigint,order:double>>")

    def take(done, p):
        free = F.filter(p["c"], lambda c: ~F.exists(done, lambda d: d["r"] == c["r"]))
        return F.when(F.size(free) == 0, done).otherwise(F.concat(done, F.array(F.struct(
            p["l"].alias("l"), F.get(free, F.lit(0))["r"].alias("r"), F.get(free, F.lit(0))["order"].alias("order")
        ))))

    return lists.groupBy(*by).agg(F.aggregate(F.sort_array(F.collect_list(turn)), empty, take).alias("m")).select(*by, F.explode("m").alias("m")).select(
        *by, F.col("m.l").alias(left), F.col("m.r").alias(right), (-F.col("m.order")).alias(score)
    )


def interpolate(matches: DataFrame, prev: DataFrame, following: DataFrame, t: float | Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """Boxes between matched ones (det_a in prev, det_b in following) at share t, a number or a column of matches.

    carried columns, such as time, identity and embedding, come from the nearer side: prev before the middle, following from there on.
    """
    share = t if isinstance(t, Column) else F.lit(t)
    a = prev.select(F.col("det_id").alias("det_a"), F.struct(*CORNERS, "confidence", *carried).alias("a"))
    b = following.select(F.col("det_id").alias("det_b"), F.struct(*CORNERS, "confidence", *carried).alias("b"))
    own = [F.when(share < 0.5, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in carried]
    return matches.join(a, "det_a").join(b, "det_b").select("det_a", "det_b", *between(F.col("a"), F.col("b"), share), *own)


def best_by_cosine(items: DataFrame, identities: DataFrame, threshold: float, most_bytes: int = 16_000_000) -> DataFrame:
    """(vec_id, id, sim): the best identity of each vector above the threshold, the smaller id on ties; NaN never matches.

    Identities are a reference list, broadcast in blocks of at most about most_bytes, whatever
    their number; one block is one pass over the items, and the winners of several are compared.
    """
    size = F.sum(F.size("embedding") * F.lit(8) + F.lit(32)).alias("bytes")
    blocks = max(1, -(-(identities.agg(size).first()["bytes"] or 0) // most_bytes))
    parts = []
    for k in range(blocks):
        own = identities.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        gathered = own.agg(F.sort_array(F.collect_list(F.struct("id", F.col("embedding").alias("v")))).alias("known"))
        sims = F.transform("known", lambda c: F.struct(dot(F.col("embedding"), c["v"]).alias("sim"), (-c["id"]).alias("minus")))
        parts.append(items.join(F.broadcast(gathered)).select("vec_id", F.array_max(F.filter(sims, lambda s: ~F.isnan(s["sim"]))).alias("best")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy("vec_id").agg(F.max("best").alias("best"))
    return out.where(F.col("best.sim") > threshold).select("vec_id", (-F.col("best.minus")).alias("id"), F.col("best.sim").alias("sim"))


def cosine_links(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_a, vec_b, sim), vec_a < vec_b, of all pairs whose dot product exceeds the threshold.

    Vectors are dealt by hash in blocks of about `block`, which are written once to the shared folder; each two
    blocks meet in a task that reads them there, and only links leave it. The work grows with the square of the rows, as an exact
    comparison of all must, but what is exchanged and written grows as the rows do; a task holds two blocks and
    the products of a strip of one with the other. Vectors or ids that are null have no links.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // block))
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    named = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    named.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("own").write.partitionBy("own").parquet(folder)

    def read(n: int) -> tuple[np.ndarray, np.ndarray]:
        store, root = store_of(folder)
        infos = store.get_file_info(fs.FileSelector(f"{root}/own={n}", allow_not_found=True))
        parts = [pq.read_table(i.path, filesystem=store, columns=["vec_id", "embedding"], partitioning=None) for i in infos if i.base_name.endswith(".parquet")]
        if not parts:
            return np.empty(0, np.int64), np.empty((0, 0))
        whole = pa.concat_tables(parts).combine_chunks()
        lists = whole["embedding"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        if (sizes != sizes[0]).any():
            raise ValueError("vectors of unlike lengths")
        return whole["vec_id"].to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, right = -1, None
        for batch in batches:
            for pair in batch.column("id").to_pylist():
                j = (math.isqrt(8 * pair + 1) - 1) // 2
                i = pair - j * (j + 1) // 2
                if j != held:
                    held, right = j, read(j)
                left = read(i) if i != j else right
                if not len(left[0]) or not len(right[0]):
                    continue
                for start in range(0, len(left[0]), STRIP):
                    ids = left[0][start : start + STRIP]
                    sims = left[1][start : start + STRIP] @ right[1].T
                    x, y = np.nonzero((sims > threshold) & (ids[:, None] < right[0][None, :]) if i == j else sims > threshold)
                    a, b = ids[x], right[0][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sims[x, y])], ["vec_a", "vec_b", "sim"])

    pairs = blocks * (blocks + 1) // 2
    tasks = max(min(pairs, 256), -(-pairs // 16))
    return spark.range(0, pairs, 1, tasks).mapInArrow(compare, "vec_a long, vec_b long, sim double").where("vec_a < vec_b")


def nearest_sample(frames: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """frames(by, ts) with sample_ts, the nearest sample time of the group, the earlier one on ties: two running windows over a union, no cross join."""
    both = frames.select(*by, "ts", F.lit(None).cast("double").alias("s")).unionByName(samples.select(*by, "ts", F.col("ts").alias("s")).distinct())
    group = Window.partitionBy(*by)
    both = both.withColumns({
        "before": F.last("s", ignorenulls=True).over(group.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)),
        "after": F.last("s", ignorenulls=True).over(group.orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, 0)),
    })
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(
        F.col("ts") - F.col("before") <= F.col("after") - F.col("ts"), F.col("before")
    ).otherwise(F.col("after"))
    return both.where("s is null").select(*by, "ts", near.alias("sample_ts")).where("sample_ts is not null").distinct()


def nearest_labelled(boxes: DataFrame, samples: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """boxes(by, ts, det_id, corners) -> (by, det_id, cluster_id, iou): the labelled box of the nearest sample time that overlaps each most.

    Only samples with a cluster_id count for the overlap, but all for the time. Overlaps must exceed `least`; the
    sample with the smaller det_id wins ties; several boxes may get one identity.
    """
    timed = boxes.join(nearest_sample(boxes.select(*by, "ts").distinct(), samples, by), [*by, "ts"])
    own = samples.where("cluster_id is not null").select(*by, F.col("ts").alias("sample_ts"), F.struct("det_id", "cluster_id", *CORNERS).alias("s"))
    pairs = timed.select(*by, "sample_ts", F.struct("det_id", *CORNERS).alias("b")).join(own, [*by, "sample_ts"]).withColumn("iou", iou(F.col("b"), F.col("s")))
    best = F.max_by("s.cluster_id", F.struct("iou", (-F.col("s.det_id")).alias("o")))
    return pairs.where(F.col("iou") > least).groupBy(*by, F.col("b.det_id").alias("det_id")).agg(best.alias("cluster_id"), F.max("iou").alias("iou"))


def assign(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Least total cost of pairing rows with columns, each at most once; every row (or column) of the shorter side is paired."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return []
    if any(not (-1e18 < c < 1e18) for row in cost for c in row):
        raise ValueError("costs must be finite")
    if n > m:
        return sorted((r, c) for c, r in assign([list(col) for col in zip(*cost)]))
    # Shortest augmenting paths over reduced costs, one row at a time.
    row_price, col_price, owner = [0.0] * n, [0.0] * m, [-1] * m
    for r in range(n):
        dist, via, done = [cost[r][c] - row_price[r] - col_price[c] for c in range(m)], [-1] * m, [False] * m
        while True:
            c = min((c for c in range(m) if not done[c]), key=dist.__getitem__)
            done[c] = True
            if owner[c] < 0:
                break
            k = owner[c]
            for d in range(m):
                through = dist[c] + cost[k][d] - row_price[k] - col_price[d]
                if not done[d] and through < dist[d]:
                    dist[d], via[d] = through, c
        end = dist[c]
        for d in range(m):
            if done[d] and d != c:
                row_price[owner[d]] += end - dist[d]
                col_price[d] -= end - dist[d]
        row_price[r] += end
        while True:
            before = via[c]
            owner[c] = r if before < 0 else owner[before]
            if before < 0:
                break
            c = before
    return sorted((r, c) for c, r in enumerate(owner) if r >= 0)


def optimal(costs: DataFrame, by: list[str]) -> DataFrame:
    """costs(by, row, col, cost), complete in each group -> (by, row, col, cost) of the optimal assignment.

    A group is one frame, whose costs travel as one list; many frames go to Python in one batch.
    """
    kind = "array<struct<row:bigint,col:bigint,cost:double>>"

    @F.arrow_udf(kind)
    def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for cells in batch:
                cost = {(c["row"], c["col"]): c["cost"] for c in cells.as_py()}
                rows, cols = sorted({r for r, _ in cost}), sorted({c for _, c in cost})
                pairs = assign([[cost.get((r, c), math.nan) for c in cols] for r in rows])
                out.append([{"row": rows[r], "col": cols[c], "cost": cost[rows[r], cols[c]]} for r, c in pairs])
            yield pa.array(out, pa.list_(pa.struct([("row", pa.int64()), ("col", pa.int64()), ("cost", pa.float64())])))

    cells = F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("row", "long"), ("col", "long"), ("cost", "double"))]))
    solved = costs.groupBy(*by).agg(cells.alias("_cells")).select(*by, solve("_cells").alias("_pairs"))
    return solved.select(*by, F.explode_outer("_pairs").alias("_pair")).select(*by, "_pair.*").where("row is not null")
