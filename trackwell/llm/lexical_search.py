"""Ranked lexical search: items times documents as a blocked product of sparse integer matrices, and the best documents of each item."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch

#: Characters of item texts, or one item, that are searched for in one pass over the documents; bounds what is broadcast.
PASS_CHARS = 4_000_000
#: Documents and postings of a block of the product, and bytes of text that are split at once.
BLOCK_DOCS, BLOCK_POSTINGS, SLICE = 16_384, 2_000_000, 4_000_000
#: Letters, digits and all bytes outside ASCII are parts of terms; A-Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> Counter:
    """How often each term, in UTF-8, stands in a text."""
    data, found, at = (text or "").encode(errors="replace"), Counter(), 0
    while at < len(data):
        stop = at + SLICE
        part = data[at:stop].translate(_LETTERS)
        if stop < len(data):  # a term that goes on is left to the next slice, unless the slice is all one term
            cut = part.rfind(b" ") + 1
            while not cut:
                stop += SLICE
                part = data[at:stop].translate(_LETTERS)
                cut = part.rfind(b" ") + 1 if stop < len(data) else len(part)
            part, stop = part[:cut], at + cut
        found.update(part.split())
        at = stop
    return found


def _passes(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, terms) in parts of PASS_CHARS. Rows of one id, which may be null, are one item; they come sorted, a partition at a time."""
    part, held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().sort("item_id").toLocalIterator():
        if part and part[-1][0] == row["item_id"]:
            part[-1][1].update(terms(row["text"]))
        else:
            if held >= PASS_CHARS:
                yield part
                part, held = [], 0
            part.append((row["item_id"], terms(row["text"])))
        held += len(row["text"] or "")
    if part:
        yield part


class Items:
    """The rows of the item-term matrix: for each item its terms' numbers and what each counts there."""

    def __init__(self, part: list[tuple[int | None, Counter]], once: bool):
        self.ids = [i for i, _ in part]
        self.number: dict[bytes, int] = {}
        columns = [[self.number.setdefault(t, len(self.number)) for t in own] for _, own in part]
        self.columns = [np.array(c, np.int64) for c in columns]
        self.counts = [np.ones(len(own), np.int64) if once else np.fromiter(own.values(), np.int64, len(own)) for _, own in part]


_POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"


def _postings(docs: DataFrame, shared) -> DataFrame:
    """One row for each document: its id, the number of its terms, and those among the items' with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        for batch in batches:
            sizes, own, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms(text.as_py())
                sizes.append(found.total())
                hits = [(number[t], c) for t, c in found.items() if t in number]
                own += [t for t, _ in hits]
                counts += [c for _, c in hits]
                ends.append(len(own))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(own, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
            ], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """10 + 90 * n * documents div total; in big integers where the product leaves 64 bits."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // total
    return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)


class Block:
    """Documents as the columns of a term-document matrix of impacts, kept by term (compressed rows)."""

    def __init__(self, tables: list[pa.RecordBatch], weights: np.ndarray, documents: int, total: int):
        rows = pa.Table.from_batches(tables)
        ids = rows["doc_id"].combine_chunks()
        self.unknown = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        held = pc.list_value_length(rows["terms"]).to_numpy()
        doc = np.repeat(np.arange(len(held)), held)
        term = pc.list_flatten(rows["terms"]).to_numpy().astype(np.int64)
        tf = pc.list_flatten(rows["counts"]).to_numpy()
        m = lengths(rows["n"].to_numpy(), documents, total)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def row(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of the product: the rows of the item's terms merged, by document."""
        out = np.zeros(len(self.ids), np.int64)
        spans = [(a, b, c) for a, b, c in zip(self.first[columns].tolist(), self.first[columns + 1].tolist(), counts.tolist()) if a < b]
        if spans:
            doc = np.concatenate([self.doc[a:b] for a, b, _ in spans])
            np.add.at(out, doc, np.concatenate([self.impact[a:b] * c for a, b, c in spans]))
        return out


def _best(score: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest positive scores, then smallest ids, null ones last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], unknown[at], -score[at]))[:k]]


def _ranked(postings: DataFrame, shared, k: int) -> DataFrame:
    """The k best documents of each item among those of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, total = shared.value
        best: dict[int, tuple[np.ndarray, ...]] = {}

        def multiply(block: list[pa.RecordBatch]) -> None:
            own = Block(block, weights, documents, total)
            for i, (columns, counts) in enumerate(zip(items.columns, items.counts)):
                score = own.row(columns, counts)
                top = _best(score, own.ids, own.unknown, k)
                if len(top):
                    found = (score[top], own.ids[top], own.unknown[top])
                    if i in best:
                        found = tuple(map(np.concatenate, zip(best[i], found)))
                        at = _best(*found, k)
                        found = tuple(x[at] for x in found)
                    best[i] = found

        held, rows, size = [], 0, 0
        for batch in batches:
            cuts = [*range(0, batch.num_rows, 1024), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                held.append(part)
                rows += part.num_rows
                size += len(part.column("terms").flatten())
                if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    multiply(held)
                    held, rows, size = [], 0, 0
        if held:
            multiply(held)
        names = ["item_id", "doc_id", "score"]
        for i, (score, ids, unknown) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([items.ids[i]] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=unknown), pa.array(score, pa.int64())], names)

    return postings.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): the k documents of highest score of each item, none with score 0.

    Equal scores go by rising doc_id, null ids last. Null and empty texts, and texts without letters or digits, have no
    terms: such a document is found by nothing and counts nowhere, such an item finds nothing. Repeated rows
    of docs are documents of their own; rows of items with one id, null among them, are one item with all their terms. A term of an
    item counts once, or as often as it stands there where `once` is false. Ids are cast to long, other columns are not looked at, an empty table on
    either side gives an empty result. Long texts are split slice by slice.

    A part of the items (PASS_CHARS) is broadcast, and documents are counted once for each part: what they hold of the
    items' terms is written as postings, from which document frequencies come. The product goes block by block of postings;
    of each task only k documents an item travel on. The driver holds a part of the items and their terms' frequencies, nothing of the documents.
    """
    spark, out = docs.sparkSession, []
    scratch = Scratch(spark, "search")
    for part in _passes(items):
        wanted = Items(part, once)
        shared = spark.sparkContext.broadcast(wanted)
        postings = scratch.save(_postings(docs, shared))
        documents, total = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not wanted.number:
            continue
        weights = np.zeros(len(wanted.number), np.int64)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        out.append(_ranked(postings, spark.sparkContext.broadcast((wanted, weights, documents, total)), k))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
