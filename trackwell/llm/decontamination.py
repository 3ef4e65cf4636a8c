"""Benchmark decontamination by the q-gram lemma: shared q-grams in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import free_name

#: Characters of a q-gram, and edits allowed for each character of an item.
Q = 10
ERROR_RATE = 0.06
#: Diagonals that a band starts with; it overlaps the next by the edit budget.
BAND = 32
#: Benchmark characters that one pass over the documents looks for; a larger benchmark takes several passes.
PASS_CHARS = 16_000_000
#: Bits of the numbers that the filter before the sorted q-grams is addressed by, at most: 16 MB in each worker.
FILTER_BITS = 27
#: Pairs of equal q-grams that are counted at a time.
PAIRS = 1 << 20

_NOT_WORD = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str | None) -> str:
    """Lower case, every run of what isn't a letter or digit as one space, no space at the ends."""
    return _NOT_WORD.sub(" ", text.lower()).strip() if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    if len(codes) < Q:
        return np.empty(0, dtype=np.uint64)
    known = {1: (codes.astype(np.uint64) + np.uint64(1)) * _MIX}
    size = 1
    while size * 2 <= Q:  # hashes of 2, 4, 8 characters from halves, then what Q lacks
        h = known[size]
        h = (h[: len(h) - size] ^ (h[size:] >> np.uint64(23))) * _MIX + h[size:]
        size *= 2
        known[size] = h
    done = size
    while done < Q:
        more = max(k for k in known if done + k <= Q)
        n = len(codes) - done - more + 1
        h = (h[:n] ^ (known[more][done : done + n] >> np.uint64(23))) * _MIX + known[more][done : done + n]
        done += more
    return h ^ (h << np.uint64(31))


def edit_budget(length: int) -> int:
    return int(ERROR_RATE * length)


def needed(length: int) -> int:
    """q-grams that a text within the edit budget of an item of this length shares with it at least."""
    return max(1, length - Q + 1 - Q * edit_budget(length))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(least edits, where they end in the text) of the whole item against any part of the text, on diagonals low to high.

    A cell of diagonal d in row i stands for item[:i] aligned up to text[:i + d].
    """
    width, n = high - low + 1, len(text)
    steps = np.arange(width)
    pad = np.full(max(0, -low) + 1, 0xFFFFFFFF, dtype=np.uint32)  # equals no character, so costs as much as leaving one out
    tail = np.full(max(0, high + len(item) - n) + 1, 0xFFFFFFFF, dtype=np.uint32)
    padded, first = np.concatenate([pad, text, tail]), len(pad) + low
    row = np.zeros(width, dtype=np.int64)
    for i, c in enumerate(item):
        new = row + (padded[first + i : first + i + width] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= steps
        row = np.minimum.accumulate(new, out=new)
        row += steps
    best = int(row.argmin())
    return int(row[best]), min(n, best + low + len(item))


class Index:
    """The q-grams of a bounded part of the benchmark, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.budget = np.array([edit_budget(len(c)) for c in self.codes], dtype=np.int64)
        self.needed = np.array([needed(len(c)) for c in self.codes], dtype=np.int64)
        self.least = int(self.needed.min(initial=1 << 40))
        self.band = np.maximum(BAND, self.budget)
        grams = [_grams(c) for c in self.codes]
        hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.bits = min(FILTER_BITS, max(10, int(len(self.hashes)).bit_length() + 7))
        marked = np.unique(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.seen = np.zeros(1 << self.bits - 3, dtype=np.uint8)
        np.bitwise_or.at(self.seen, marked >> 3, (1 << (marked & 7)).astype(np.uint8))

    def regions(self, grams: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) that hold enough shared q-grams; band b of an item starts at diagonal b times its band width."""
        mark = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.seen[mark >> 3] >> (mark & 7).astype(np.uint8) & 1)
        if not len(self.ids) or len(at) < self.least:
            return []
        slot = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == grams[at]
        at, slot = at[hit], slot[hit]
        if len(at) < self.least:
            return []
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(self.count[slot])
        cuts = [0]
        while cuts[-1] < len(at):
            base = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, base + PAIRS, side="right"))))
        for lo, hi in zip(cuts, cuts[1:]):
            n = self.count[slot[lo:hi]]
            pair = np.repeat(self.first[slot[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, diagonal = self.item[pair], np.repeat(at[lo:hi], n) - self.place[pair]
            width = self.band[item]
            band = diagonal // width
            shared = diagonal - band * width < self.budget[item]  # the band before reaches this far
            both = np.concatenate([(item << 32) + band + (1 << 30), (item[shared] << 32) + band[shared] - 1 + (1 << 30)])
            k, c = np.unique(both, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
        keys = keys[counts >= self.needed[keys >> 32]]
        return [(int(k >> 32), int((k & 0xFFFFFFFF) - (1 << 30))) for k in keys]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, stop, edits) in the normalized text: the best place of each item within its budget."""
        codes = _codes(text)
        best: dict[int, tuple[int, int]] = {}
        for item, band in self.regions(_grams(codes)):
            budget, width, m = int(self.budget[item]), int(self.band[item]), len(self.codes[item])
            low, high = band * width - budget, (band + 1) * width + 2 * budget
            lo, hi = max(0, low), min(len(codes), high + m)
            edits, stop = banded_distance(self.codes[item], codes[lo:hi], low - lo, high - lo)
            if edits <= budget:
                best[item] = min(best.get(item, (edits, lo + stop)), (edits, lo + stop))
        return [(self.ids[i], max(0, stop - len(self.codes[i])), stop, edits) for i, (edits, stop) in sorted(best.items())]


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct usable items, in parts of PASS_CHARS; rows come one partition at a time."""
    part, held = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        text = normalize(row["text"])
        if len(text) < 2 * Q:
            continue
        part.append((row["item_id"], text))
        held += len(text)
        if held >= PASS_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


_NAMES = ("item_id", "start", "stop", "edits")
_KIND = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:bigint>>"


_held: list = [None, None]


def _index_of(items: list[tuple[int, str]]) -> Index:
    """The index of a broadcast part, made once in each worker process while that part is looked for."""
    if _held[0] is not items:
        _held[:] = items, Index(items)
    return _held[1]


def _search(shared):
    """A function of texts that lists what they hold of a broadcast part of the benchmark."""

    @F.arrow_udf(_KIND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index_of(shared.value)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in _NAMES]))
        for batch in batches:
            found = [index.matches(normalize(t.as_py())) for t in batch]
            yield pa.array([[dict(zip(_NAMES, x)) for x in row] for row in found], kind)

    return search.asNondeterministic()  # or Spark would search again for the filters that it infers


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs joined with what they hold of the benchmark: docs' columns and a struct `leak` (item_id, start, stop, edits).

    One row for each row of docs and item that the normalized text holds within the edit
    budget; start and stop count characters of the normalized text (start is that of an
    alignment without net insertions). Case, punctuation and spacing don't matter. Null and
    empty texts hold nothing. Items shorter than two q-grams, and null ones, are not looked
    for. An empty table on either side gives an empty result. The documents are never
    shuffled: every part of the benchmark is one bounded broadcast and one pass over them.
    """
    spark, name = docs.sparkSession, free_name(docs, "leak")
    parts = []
    for items in _passes(benchmark):
        shared = spark.sparkContext.broadcast(items)
        leaks = free_name(docs, "_leaks")
        parts.append(
            docs.withColumn(leaks, _search(shared)("text")).where(F.size(leaks) > 0)
            .select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(leaks).alias(name))
        )
    if not parts:
        return docs.withColumn(name, F.lit(None).cast(_KIND[6:-1])).where("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item of the benchmark; all other rows stay as they are, null and empty texts and repeated rows among them."""
    hit, out = free_name(docs, "_hit"), docs
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = out.withColumn(hit, F.size(_search(shared)("text")) > 0).where(~F.col(hit)).drop(hit)
    return out
