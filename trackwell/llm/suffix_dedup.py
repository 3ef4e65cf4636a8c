"""Removal of long repeated byte strings: sampled suffixes in order, the other strings merged in, adjacent prefixes compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm import suffix_array
from trackwell.llm.common import Scratch, free_name
from trackwell.llm.suffix_array import GRAM, SPREAD, Runs

#: Bytes of a string that counts as repeated.
LENGTH = 400
#: Different contexts of one group that a task sorts together; larger groups are cut by their strings' places, see repeated_spans.
GROUP = 16_384
#: Runs of strings are cut into pieces of so many, level by level, where a group is too large.
WIDTHS = (SPREAD, 16, 1)
#: Contexts that a task sorts at a time, whole groups together.
TOGETHER = 8_192

_KEYED = "k1 long, k2 long, place long, h long, g long"


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each starts and ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def _place(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return p << 16 | a << 8 | b


def _span(p: Column, a: Column, b: Column) -> Column:
    """Strings that start p - b to p - a, as one long: the first start, and how many follow."""
    return F.shiftleft(p - b, 8) + b - a


def _of_place(place: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(place, 16), F.shiftright(place, 8).bitwiseAND(F.lit(255)), place.bitwiseAND(F.lit(255))


def _keyed(k1: np.ndarray, k2: np.ndarray, found: Runs) -> pa.RecordBatch:
    columns = (k1[found.doc], k2[found.doc], _place(found.p, found.a, found.b), found.h, found.g)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "place", "h", "g"])


def _all_runs(texts: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
                for found in suffix_array.runs(*_texts(batch.column("text")), length):
                    yield _keyed(k1, k2, found)

    return texts.mapInArrow(scan, _KEYED)


def _finer_runs(texts: DataFrame, asked: DataFrame, length: int, width: int) -> DataFrame:
    """asked(k1, k2, places) -> the same runs in pieces of width strings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            data, offsets = _texts(batch.column("text"))
            for i, places in enumerate(batch.column("places")):
                x = np.unique(places.values.to_numpy())
                for found in suffix_array.pieces(data[offsets[i] : offsets[i + 1]], x >> 16, x >> 8 & 255, x & 255, length, width):
                    yield _keyed(k1[i : i + 1], k2[i : i + 1], found)

    return texts.join(asked.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(scan, _KEYED)


def _contexts(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """asked(k1, k2, runs: array of struct(place, h, asked)) -> one row for each run, with the bytes before and after its sampled place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            data, lists = data.tobytes(), batch.column("runs")
            n = np.diff(lists.offsets.to_numpy())
            doc, flat = np.repeat(np.arange(len(n)), n), lists.flatten()
            place = flat.field("place").to_numpy()
            p, a, b = (place >> 16) + offsets[doc], place >> 8 & 255, place & 255
            sides = [(p - b, p), (p, p - a + length)]
            columns = [
                *(batch.column(c).take(pa.array(doc)) for c in ("k1", "k2")), *(flat.field(c) for c in ("place", "h", "asked")),
                *(pa.array([data[i:j] for i, j in zip(lo.tolist(), hi.tolist())], pa.binary()) for lo, hi in sides),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "place", "h", "asked", "before", "after"])

    return texts.join(asked.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(
        cut, "k1 long, k2 long, place long, h long, asked boolean, before binary, after binary"
    )


def _compared(table: pa.Table, length: int) -> pa.RecordBatch:
    """(k1, k2, span) of the strings in the asked runs that occur in another run of the group too."""
    table = table.combine_chunks()
    place, h = table["place"].to_numpy(), table["h"].to_numpy()
    p, a, b = place >> 16, place >> 8 & 255, place & 255
    sides = []
    for name, width, backwards in (("before", SPREAD, True), ("after", length, False)):
        column = table[name].chunk(0)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        sides.append(suffix_array._matrix(np.frombuffer(column.buffers()[2] or b"", np.uint8), ends, width, backwards))
    found = suffix_array.repeated(np.unique(h, return_inverse=True)[1], a, b, *sides, length)
    found &= table["asked"].to_numpy()[:, None]
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1  # of the same run, since both go row by row
    span = (p[row] - high) << 8 | (high - low)
    return pa.RecordBatch.from_arrays([*(pa.array(table[c].to_numpy()[row]) for c in ("k1", "k2")), pa.array(span)], ["k1", "k2", "span"])


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """contexts, each group in one partition and together -> (k1, k2, span)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield _compared(table.slice(0, cut), length)
                held = table.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield _compared(pa.Table.from_batches(held), length)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(work, "k1 long, k2 long, span long")


def _settled(texts: DataFrame, make: Callable[[], DataFrame], scratch: Scratch, length: int, level: int) -> list[DataFrame]:
    """Tables (k1, k2, span) of the repeated strings among the runs that `make` gives."""
    counted = make().groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high"))
    counted = scratch.save(counted.where("n > 1").select("h", (F.col("low") == F.col("high")).alias("same")))
    hits = scratch.save(make().join(counted.hint("shuffle_hash"), "h"))
    span = _span(*_of_place(F.col("place"))).alias("span")
    out = [hits.where("same").select("k1", "k2", span)]
    unlike = hits.where("not same")
    contexts = scratch.save(unlike.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at")))
    out.append(unlike.join(contexts.where("n > 1").select("h", "g").hint("shuffle_hash"), ["h", "g"], "left_semi").select("k1", "k2", span))
    sizes = contexts.groupBy("h").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("asked")).where("asked > 0")
    sized = contexts.join(sizes.select("h", "size").hint("shuffle_hash"), "h").select("h", "at.*", (F.col("n") == 1).alias("asked"), "size")
    small = sized.where(F.col("size") <= GROUP).groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "h", "asked")).alias("runs"))
    out.append(scratch.save(_compare(_contexts(texts, small, length), length)))
    large = sized.where(F.col("size") > GROUP).groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    if level + 1 < len(WIDTHS) and not sizes.where(F.col("size") > GROUP).isEmpty():
        large = scratch.save(large)
        finer = lambda: _finer_runs(texts, large, length, WIDTHS[level + 1])
        out += _settled(texts, finer, scratch, length, level + 1)
    return out


def _merged(found: DataFrame, name: str, length: int) -> DataFrame:
    """found(k1, k2, span) -> (k1, k2, name): the union of a row's strings as struct(start, stop)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("span"):
                x = np.sort(own.values.to_numpy())
                start, reach = x >> 8, np.maximum.accumulate((x >> 8) + (x & 255) + length)
                new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                stop = reach[np.append(new[1:] - 1, len(x) - 1)]
                out.append([{"start": i, "stop": j} for i, j in zip(start[new].tolist(), stop.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, kind)], ["k1", "k2", name])

    lists = found.groupBy("k1", "k2").agg(F.collect_list("span").alias("span"))
    return lists.mapInArrow(merge, f"k1 long, k2 long, `{name}` array<struct<start:bigint,stop:bigint>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """docs with an array column `spans` of struct(start, stop): the bytes covered by a string of `length` bytes that starts elsewhere too.

    Texts are UTF-8 bytes; null and shorter texts have none. Strings never cross documents,
    may overlap, and count when they occur twice in one document. All occurrences are
    covered. Repeated rows repeat each other. An empty table gives an empty result.

    Each string has a sampled place among its first SPREAD bytes that its own bytes choose, so
    equal strings have it alike and meet in the group of those whose following length + 1 - SPREAD
    bytes agree. Strings of one sampled place form a run, with the bytes around as its context.
    Equal contexts are counted, not sorted: any that occurs twice is repeated throughout, and
    one stands for all. In groups of unlike contexts the sampled suffixes are sorted by names of
    triples, upon names again; the strings that start before a sampled place are merged in by
    their bytes up to it and its rank; neighbours' common prefixes decide (suffix_array.repeated).

    A group of more than GROUP contexts, as a passage gives that stands in a great many
    texts, is cut: its runs become pieces of 16 strings, grouped anew by the bytes that all
    strings of a piece have, and where that is too many still, single strings that only need
    to be counted. Groups and contexts are told apart by two 64-bit hashes. Columns k1 and k2,
    made of id and text, name a row; rows that agree in both have the same spans.
    """
    if length < SPREAD + 2 * GRAM:
        raise ValueError(f"length must be at least {SPREAD + 2 * GRAM}")
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    one, two, name = (free_name(docs, n) for n in ("_k1", "_k2", "spans"))
    second = F.xxhash64("text")
    first = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text"))
    texts = docs.where(F.octet_length("text") >= length).select(first.alias("k1"), second.alias("k2"), "text")
    found = _settled(texts, lambda: _all_runs(texts, length), scratch, length, 0)
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    spans = _merged(every, name, length).withColumnsRenamed({"k1": one, "k2": two})
    out = docs.withColumns({one: first, two: second}).join(spans.hint("shuffle_hash"), [one, two], "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(name), none).alias(name))


def kept_bytes(text: Column, spans: Column) -> Column:
    """What is left of the text's bytes, concatenated; none of a null text."""

    @F.arrow_udf("binary")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for text, spans in zip(texts, lists):
                data = memoryview(text.as_buffer() or b"")
                done, parts = 0, []
                for s in spans.as_py():
                    parts.append(data[done : s["start"]])
                    done = s["stop"]
                out.append(b"".join([*parts, data[done:]]) if done else data)
            yield pa.array(out, pa.binary())

    changed = F.size(spans) > 0
    return F.when(changed, cut(F.when(changed, text), spans)).otherwise(F.coalesce(text.cast("binary"), F.lit(b"")))
