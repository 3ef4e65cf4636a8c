"""Byte-pair encoding and decoding with a given vocabulary: merges found by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import free_name

#: Code points that are assigned in later versions of Unicode than the vocabulary's library knows; it takes them for symbols.
LATER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The pieces of a text that are encoded one by one, a fixed rule of byte-level vocabularies.
_L, _N = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])+|\s+(?!\S)|\s+"
#: Words that a worker remembers (twice as many at most), and the longest of them in characters.
REMEMBERED, KEPT_CHARS = 250_000, 32
#: Characters of text that are encoded together, and the longest pieces, in bytes, that are merged side by side in arrays.
TOGETHER, SIDE_BY_SIDE = 2_000_000, 64
#: Bytes of the tokens that are decoded as rows of a table.
WIDE = 16
NONE = 1 << 62
ABSENT = np.int32((1 << 31) - 1)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merged(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> list[int]:
    """The symbols of one piece after all merges. ranks[a].get(b): the rank of a pair; made: the symbol that each rank makes.

    A segment tree holds the key (rank, place) of every adjacent pair. Its root is the leftmost
    pair of the lowest rank; a merge changes three leaves.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    bits = n.bit_length()
    size, mask = 1 << (n - 2).bit_length(), (1 << bits) - 1
    tree = [NONE] * (2 * size)
    place = 0
    for a, b in zip(symbols, symbols[1:]):
        rank = ranks[a].get(b)
        if rank is not None:
            tree[size + place] = rank << bits | place
        place += 1
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != NONE:
        left = best & mask
        right = after[left]
        end, start = after[right], before[left]
        own = symbols[left] = made[best >> bits]
        symbols[right] = -1
        after[left] = end
        changed = []
        if end < n:  # a symbol follows, so the right one had a pair
            before[end] = left
            changed.append((right, NONE))
            rank = ranks[own].get(symbols[end])
            changed.append((left, NONE if rank is None else rank << bits | left))
        else:
            changed.append((left, NONE))
        if start >= 0:
            rank = ranks[symbols[start]].get(own)
            changed.append((start, NONE if rank is None else rank << bits | start))
        for place, key in changed:
            i = size + place
            if tree[i] == key:
                continue
            tree[i] = key
            while i > 1:
                other = tree[i ^ 1]
                if other < key:
                    key = other
                i >>= 1
                if tree[i] == key:
                    break
                tree[i] = key
    return [s for s in symbols if s >= 0]


def merged_side_by_side(symbols: np.ndarray, lengths: np.ndarray, width: int, rank_of, made: np.ndarray) -> np.ndarray:
    """`merged` for many short pieces at once: symbols (pieces, width), -1 in place of those merged away and beyond the end.

    Each piece has its own tree, a row of 2 * width keys; one round takes every piece's root, merges
    its pair and mends the three paths from the changed leaves, so a piece takes as many rounds as it has merges.
    """
    n = len(symbols)
    symbols = symbols.ravel()
    tree = np.full((n, 2 * width), ABSENT, np.int32)
    place = np.arange(width, dtype=np.int32)
    pair = place[None, : width - 1] < lengths[:, None] - 1
    rank = rank_of(symbols.reshape(n, width)[:, :-1][pair], symbols.reshape(n, width)[:, 1:][pair])
    tree[:, width : 2 * width - 1][pair] = np.where(rank == ABSENT, ABSENT, rank * width + np.broadcast_to(place[: width - 1], pair.shape)[pair])
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    tree = tree.ravel()
    after = np.tile(np.arange(1, width + 1), n)
    before = np.tile(np.arange(-1, width - 1), n)
    rows = np.flatnonzero(tree[1 :: 2 * width] != ABSENT)

    def put(at: np.ndarray, root: np.ndarray, leaf: np.ndarray, keys) -> None:
        node = leaf + width
        tree[root + node] = keys
        while len(at) and node[0] > 1:
            node >>= 1
            own = root + node
            both = own + node
            tree[own] = np.minimum(tree[both], tree[both + 1])

    while len(rows):
        base, root = rows * width, rows * (2 * width)
        best = tree[root + 1]
        left = (best % width).astype(np.int64)
        right = after[base + left]
        end = after[base + right]
        own = made[best // width]
        symbols[base + left], symbols[base + right] = own, -1
        after[base + left] = end
        follows = end < lengths[rows]
        before[(base + end)[follows]] = left[follows]
        keys = np.full(len(rows), ABSENT, np.int32)
        found = rank_of(own[follows], symbols[(base + end)[follows]])
        keys[follows] = np.where(found == ABSENT, ABSENT, found * width + left[follows])
        put(rows, root, right, ABSENT)
        put(rows, root, left, keys)
        start = before[base + left]
        led = start >= 0
        start = start[led]
        found = rank_of(symbols[base[led] + start], own[led])
        put(rows[led], root[led], start, np.where(found == ABSENT, ABSENT, found * width + start))
        rows = rows[tree[root + 1] != ABSENT]
    return symbols.reshape(n, width)


class Codec:
    """A byte-level vocabulary: ids of a text and the text of ids. What it remembers stays in the worker that uses it."""

    def __init__(self, vocabulary: str):
        found = json.loads(vocabulary)
        model, own = found["model"], found.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or found.get("normalizer") or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True):
            raise ValueError("not a plain byte-level pair vocabulary")
        if any(t[k] for t in found["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their neighbours are not supported")
        letters, vocab = _byte_letters(), model["vocab"]
        self.first = [vocab[c] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a]].setdefault(vocab[b], rank)
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        self.bytes = {i: b"".join(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for t, i in [*vocab.items(), *self.added.items()]}
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(PIECE, regex.V1).findall
        self.uneven = re.compile(r"\s (?:\s|\Z)").search
        self.markers = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        self.marker = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).findall if self.added else None
        keys = np.fromiter((a << 32 | b for a, own in enumerate(self.ranks) for b in own), np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(NONE))
        self.pair_ranks = np.append(np.fromiter((r for own in self.ranks for r in own.values()), np.int32)[order], ABSENT)
        self.made_array, self.first_array = np.array(self.made, np.int32), np.array(self.first, np.int32)
        all_bytes = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.sizes = np.fromiter(map(len, all_bytes), np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(all_bytes), np.uint8)
        self.wide = np.frombuffer(b"".join(b[:WIDE].ljust(WIDE, bytes(1)) for b in all_bytes), np.uint8).reshape(-1, WIDE)
        self.inside = np.arange(WIDE) < np.arange(WIDE + 1)[:, None]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("first", "made", "ranks", "added", "bytes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or ABSENT."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], ABSENT)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and where those of each piece end."""
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        lengths = np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        symbols = self.first_array[data]
        low = 1
        while low < SIDE_BY_SIDE:
            width = max(4, 2 * low)
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            for part in np.array_split(own, 1 + len(own) * width // 1_000_000):
                place = np.arange(width)[None, :]
                inside = place < lengths[part][:, None]
                at = (starts[part][:, None] + place)[inside]
                grid = np.full((len(part), width), -1, np.int32)
                grid[inside] = symbols[at]
                symbols[at] = merged_side_by_side(grid, lengths[part], width, self._rank_of, self.made_array)[inside]
            low = width
        for k in np.flatnonzero(lengths > low):
            own = merged(symbols[starts[k] : starts[k] + lengths[k]].tolist(), self.ranks, self.made)
            symbols[starts[k] : starts[k] + lengths[k]] = own + [-1] * (int(lengths[k]) - len(own))
        kept = symbols >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[starts + lengths]
        return symbols[kept], ends

    def _learn(self, words: list[str]) -> None:
        """Encodes words, each with the space before it, all at once."""
        pieces, until = [], [0]
        for word in words:
            if word.isalpha() and word.isascii():
                pieces.append(" " + word)
            elif word[:-1].isalpha() and word.isascii() and word[-1] in ",.":
                pieces += " " + word[:-1], word[-1]
            else:
                pieces += self.split(" " + word)
            until.append(len(pieces))
        self.known.update(zip(words, self._parts(pieces, until)))

    def _parts(self, pieces: list[str], until: list[int]) -> list[bytes]:
        """The ids, as bytes, of each run of pieces between two of the cuts."""
        ids, ends = self._pieces(pieces)
        data, cuts = ids.tobytes(), np.concatenate([[0], 4 * ends])[until].tolist()
        return list(map(data.__getitem__, map(slice, cuts, cuts[1:])))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids, as bytes, of texts without added tokens.

        No piece goes on over a space that has a solid character on one side, so words are looked up
        whole, with the space before them; texts with other spaces are cut into pieces one by one.
        """
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        pieces, until, parted, found, fresh = [], [0], [], [], {}
        for text in texts:
            first, *words = [text] if self.uneven(text) else text.split(" ")
            pieces += self.split(first)
            until.append(len(pieces))
            parts = list(map(known.get, words))
            holes, at = [], -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                word = words[at]
                if (ids := older.get(word)) is not None:
                    parts[at] = known[word] = ids
                else:
                    fresh[word] = None
                    holes.append((at, word))
            found.append(parts)
            parted.append(holes)
        self._learn(list(fresh))
        out = []
        for first, parts, holes in zip(self._parts(pieces, until), found, parted):
            for at, word in holes:
                parts[at] = known[word]
            out.append(b"".join((first, *parts)))
        for word in fresh:
            if len(word) > KEPT_CHARS:
                del known[word]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, of 32 bits."""
        marks = [self.marker(t) if self.marker else [] for t in texts]
        parts = [self.markers(t) if m else [t] for t, m in zip(texts, marks)]
        ids = iter(self._plain(list(chain.from_iterable(parts))))
        out = []
        for own, between in zip(parts, marks):
            found = [next(ids) for _ in own]
            joined = [found[0]]
            for mark, more in zip(between, found[1:]):
                joined += [np.int32(self.added[mark]).tobytes(), more]
            out.append(np.frombuffer(b"".join(joined), np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Ids that the vocabulary lacks stand for nothing; bytes that are no UTF-8 become replacement characters."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        if len(ids) and sizes.max() <= WIDE:
            out = self.wide[ids][self.inside[sizes]]
        else:
            ends = np.cumsum(sizes)
            out = self.data[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        return out.tobytes().decode("utf-8", "replace")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as file:
        return Codec(file.read())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with an array of the token ids of the whole text (null and empty texts: none) in a column `ids`, renamed where docs has one.

    path names a byte-level vocabulary in JSON, read by the driver and sent to the workers once;
    its size bounds what is sent. Added tokens in a text are found as such. Rows are encoded where
    they are: repeated rows alike, other columns as they were, an empty table stays empty. A piece without
    a boundary takes n log n steps, however long. Where `decoded` names a column, it gets what `decode` makes of the ids, without
    their way to another worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_codec(path or vocabulary_path()))
    both = decoded is not None

    def column(codec: Codec, texts: list[str]) -> pa.Array:
        found = codec.encode_all(texts)
        ends = np.cumsum([0, *map(len, found)])
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))
        return pa.StructArray.from_arrays([out, pa.array(map(codec.decode, found), pa.string())], ["ids", "decoded"]) if both else out

    @F.arrow_udf("struct<ids:array<int>,decoded:string>" if both else "array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.value
        for batch in batches:
            held, size = [], 0
            for t in batch:
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER:
                    yield column(codec, held)
                    held, size = [], 0
            yield column(codec, held)

    name = free_name(docs, ids)
    out = docs.withColumn(name, run(text))
    if both:
        kept = [F.col(f"`{c}`") for c in docs.columns]
        out = out.select(*kept, F.col(f"{name}.ids").alias(name), F.col(f"{name}.decoded").alias(free_name(out, decoded)))
    return out


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its ids (null: empty text) in a column `decoded`, renamed where that is taken. Added tokens are written out."""
    shared = encoded.sparkSession.sparkContext.broadcast(_codec(path or vocabulary_path()))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.value
        for batch in batches:
            ends, values = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
            yield pa.array([codec.decode(values[a:b]) for a, b in zip(ends, ends[1:])], pa.string())

    return encoded.withColumn(free_name(encoded, text), run(ids))
