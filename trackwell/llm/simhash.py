"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackwell.llm.common import Scratch
from trackwell.llm.components import connected_components, keep_first

#: Bits of each block of a 64-bit fingerprint.
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Fingerprints that one task compares with each other at most, by halves.
TILE = 1024


def _fingerprint(text: str | None, shingle: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends)], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit SimHash of a text's word shingles, as a signed long; null and blank texts give 0."""

    @arrow_udf("long")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = np.fromiter((_fingerprint(t.as_py(), shingle) for t in batch), dtype=np.uint64, count=len(batch))
            yield pa.array(prints.view(np.int64))

    return compute(text)


def _blocks(bits: Column) -> list[Column]:
    out, at = [], 0
    for width in BLOCK_BITS:
        out.append(F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def _spanning(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what is linked among the members, one fewer than members at most."""
    if len(members) == 2:
        a, b = int(members[0]), int(members[1])
        return [(a, b)] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance else []
    bits = members.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    label = np.arange(len(members))
    while True:
        least = np.where(near, label[None, :], len(members)).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    return [(int(members[i]), int(members[r])) for i, r in enumerate(label) if i != r]


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """prints(fp), distinct -> edges (u, v) with the same connected components as all pairs within `distance`.

    A fingerprint is cut in five blocks. Two that differ in three bits or fewer agree on at
    least two whole blocks, so they meet under one of the ten keys made of two blocks. A key
    with many members is dealt out in square tiles (row part, column part) of bounded size;
    every pair still meets in one tile. Each tile verifies the Hamming distances and sends a
    spanning forest of its links, never all pairs.
    """
    if not 0 <= distance <= len(BLOCK_BITS) - 2:
        raise ValueError(f"distance must be 0 to {len(BLOCK_BITS) - 2}")
    parts = _blocks(F.col("fp"))
    keys = F.array(*[
        F.lit(n << 26).bitwiseOR(F.shiftleft(parts[a], 13)).bitwiseOR(parts[b])
        for n, (a, b) in enumerate(combinations(range(len(BLOCK_BITS)), 2))
    ])
    keyed = prints.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts_of = F.ceil(F.col("n") / TILE).cast("int")
    tiled = (
        keyed.join(sizes, "key")
        .withColumn("parts", parts_of)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found = [pair for i in range(len(at) - 1) for pair in _spanning(flat[at[i] : at[i + 1]], distance)]
            u, v = zip(*set(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tiled.mapInArrow(verify, "u long, v long")


def grouped(docs: DataFrame, shingle: int, distance: int, scratch: Scratch) -> DataFrame:
    """One row per row of docs: doc_id, th (xxhash64 of the text), fp, root (a fingerprint), component_id."""
    marked = scratch.save(docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint(F.col("text"), shingle).alias("fp")))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(classes.select("fp"), distance), scratch)
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = scratch.save(placed)
    merged = placed.join(roots.select(F.col("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("whole"))
    ids = placed.join(merged, "root", "left").select("fp", "root", F.coalesce("whole", "least").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id.

    component_id is the smallest doc_id that links reach, the row's own included. Documents of
    equal fingerprint count as linked, blank and null texts too. Rows with a null doc_id take
    part but don't name a component unless it has no other id (then component_id is null).
    Repeated rows give repeated rows. An empty table gives an empty result.
    """
    return grouped(docs, shingle, distance, scratch or Scratch(docs.sparkSession, "simhash")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each component, see components.keep_first; null and blank texts are one component. An empty table stays empty."""
    return keep_first(docs, grouped(docs, shingle, distance, Scratch(docs.sparkSession, "simhash-keep")))
