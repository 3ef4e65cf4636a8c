"""Near-duplicates by word shingles: MinHash bands find candidates, exact Jaccard similarity decides, components group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackwell.llm import simhash
from trackwell.llm.common import Scratch
from trackwell.llm.components import connected_components, keep_first

#: Words of a shingle; texts that share four fifths of their shingles are near-duplicates.
SHINGLE = 5
#: 24 bands of 4 minima: a pair of similarity 0.8 shares none with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Texts that one task compares with each other at most, by halves.
TILE = 128
#: Members of a large band that all its parts are compared with, so that links join the parts.
HUBS = 8
_RNG = np.random.default_rng(4)
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = "struct<cid:bigint,bands:array<bigint>>"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array(
        [digest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(max(1, len(words) - SHINGLE + 1))], dtype=np.uint64
    ))


def _bands(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        least = np.minimum(least, (own[None, at : at + 1024] * _FACTORS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], dtype=np.uint64)


def _class_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def _marks(text: Column, banded: bool) -> Column:
    """struct(cid, bands): a hash of the text's shingle set, equal for texts of equal sets, and its bands."""

    @arrow_udf(_PAIR)
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cids, bands = [], []
            for t in batch:
                own = shingles(t.as_py())
                cids.append(_class_of(own))
                bands.append(_bands(own).view(np.int64) if banded and len(own) else [])
            yield pa.StructArray.from_arrays(
                [pa.array(np.array(cids, dtype=np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["cid", "bands"]
            )

    return compute(text)


def _sets(text: Column) -> Column:
    @arrow_udf("array<bigint>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t.as_py()).view(np.int64) for t in batch], pa.list_(pa.int64()))

    return compute(text)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _compare(group: pa.Table) -> pa.Table:
    """Edges that connect exactly what is linked in a tile; pairs that are connected already, there or by their roots, aren't compared."""
    cids = group["cid"].to_pylist()
    sets = [np.asarray(s.values) for s in group["own"]]
    first: dict[int, int] = {}
    root = [first.setdefault(r, i) for i, r in enumerate(group["root"].to_pylist())]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i in range(len(cids)):
        for j in range(i):
            a, b = top(i), top(j)
            if a != b and similar(sets[i], sets[j]):
                root[a] = b
                found.append((cids[i], cids[j]))
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _links(tiles: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """tiles(members), arrays of struct(cid, root) -> edges (u, v); shingle sets are made again for the members only."""
    tiles = tiles.where(F.size("members") > 1).select(F.sort_array("members").alias("members"))
    tiles = scratch.save(tiles.withColumn("tid", F.xxhash64("members")).dropDuplicates(["tid"]))
    placed = tiles.select("tid", F.explode("members").alias("m")).select("tid", "m.*")
    wanted = reps.join(placed.select("cid").distinct(), "cid", "left_semi")
    texts = docs.select(F.xxhash64("text").alias("th"), "text").groupBy("th").agg(F.first("text").alias("text"))
    sets = scratch.save(wanted.join(texts, "th").select("cid", _sets(F.col("text")).alias("own")))
    edges = placed.join(sets, "cid").groupBy("tid").applyInArrow(_compare, "u long, v long")
    return scratch.save(edges)


def grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of docs: doc_id, th (xxhash64 of the text), cid (long, of the shingle set), root (a cid), component_id, the smallest doc_id that links reach.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more;
    blank and null texts are linked with each other. Texts that share a band are compared: small
    bands at once; a large one is dealt in parts first, and only if links leave it in several
    components are those outside the largest one compared with all its parts. Every pair of a band is
    so compared, or connected without. Rows with a null doc_id take part but don't name a
    component unless it has no other id (then component_id is null). An empty table gives an empty result.

    Parts of a large band share a few members, so that their links mostly make one component of it. Where
    some members are left outside, only they are compared with all the rest: the rows grow with those outside, not with the band's square.
    """
    marked = scratch.save(
        docs.select("doc_id", F.xxhash64("text").alias("th"), _marks(F.col("text"), True).alias("m")).select("doc_id", "th", "m.*")
    )
    reps = marked.groupBy("cid").agg(F.min("th").alias("th"))
    keyed = marked.select("cid", F.explode("bands").alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
                          .withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("parts")).cast("int")))
    hub = F.explode(F.slice(F.sort_array(F.collect_set("cid")), 1, HUBS))
    large = shared.where("parts > 1")
    hubs = large.where(F.col("own") == 0).groupBy("key", "parts").agg(hub.alias("cid")).select("key", "cid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    first = shared.select("key", "cid", "own").unionByName(hubs).groupBy("key", "own").agg(F.collect_set(F.struct("cid", F.col("cid").alias("root"))).alias("members"))
    edges = _links(first.select("members"), reps, docs, scratch)
    if not large.isEmpty():
        roots = connected_components(edges, scratch)
        rooted = large.select("key", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        of_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = of_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"))
        left = scratch.save(rooted.join(main.where("outside > 0"), "key").select(
            "key", F.struct("cid", "root").alias("m"), (F.col("root") != F.col("main")).alias("out"),
            F.ceil(F.col("outside") / TILE).cast("int").alias("rows"), F.ceil(F.col("n") / TILE).cast("int").alias("columns"), F.xxhash64("cid", "key").alias("at"),
        ))
        count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        everyone = left.select("key", "m", count("rows").alias("i"), F.pmod("at", F.col("columns")).cast("int").alias("j"))
        outside = left.where("out").select("key", "m", F.pmod("at", F.col("rows")).cast("int").alias("i"), count("columns").alias("j"))
        tiled = everyone.unionByName(outside).groupBy("key", "i", "j").agg(F.collect_set("m").alias("members"))
        edges = edges.unionByName(_links(tiled.select("members"), reps, docs, scratch))
    roots = connected_components(edges, scratch)
    least = marked.groupBy("cid").agg(F.min("doc_id").alias("least"))
    placed = scratch.save(least.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    merged = placed.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("whole"))
    ids = placed.join(merged, "root", "left").select("cid", "root", F.coalesce("whole", "least").alias("component_id"))
    return marked.join(ids, "cid").select("doc_id", "th", "cid", "root", "component_id")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, cid and component_id of every row of docs, see grouped."""
    return grouped(docs, scratch or Scratch(docs.sparkSession, "similarity")).select("doc_id", "cid", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, see components.keep_first; null and blank texts are one component. An empty table stays empty."""
    return keep_first(docs, grouped(docs, Scratch(docs.sparkSession, "similarity-keep")))


def keep_one_by_both(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each component of both links together: SimHash fingerprints within `distance` bits, and shingle sets of similarity 0.8 or more.

    No link of either kind is lost: a text that is linked by its fingerprint to one and by its set to another joins their components. Which row stays, and null, blank and
    empty input, as in keep_one.
    """
    scratch = Scratch(docs.sparkSession, "near-copies-keep")
    sets = scratch.save(grouped(docs, scratch).select("doc_id", "th", "root"))
    prints = simhash.grouped(docs, shingle, distance, scratch).select("th", F.col("root").alias("print")).distinct()
    pairs = scratch.save(sets.select("th", "root").distinct().join(prints, "th").select("root", "print").distinct())
    hubs = pairs.groupBy("print").agg(F.min("root").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = scratch.save(pairs.join(hubs, "print").where("root <> hub").select(F.col("root").alias("u"), F.col("hub").alias("v")).distinct())
    joined = connected_components(edges, scratch).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return keep_first(docs, sets.join(joined, "root", "left").select("doc_id", "th", F.coalesce("whole", "root").alias("root")))
