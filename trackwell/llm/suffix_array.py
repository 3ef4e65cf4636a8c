"""Suffixes at places chosen by content: where they stand, their order by names of triples, what neighbours share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of the strings whose hashes choose sampled places, and how many neighbours each is compared with (a power of two).
GRAM = 16
SPREAD = 256
#: Bytes that are looked at together; longer inputs take several blocks.
BLOCK = 1 << 16

_POSITION = np.uint64((1 << 21) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, from halves."""
    a, b = (np.uint64(x) for x in _BASES)
    h, size = (data.astype(np.uint64) + np.uint64(1)) * a, 1
    while size < GRAM:
        left = h[: max(0, len(h) - size)] * a
        left ^= left >> np.uint64(29)
        h = (left + h[size:]) * b ^ (h[size:] >> np.uint64(32))
        size *= 2
    return h


def _leaders(h: np.ndarray, n: int) -> np.ndarray:
    """For each of n starts, the first place with the least hash among the SPREAD places from there on."""
    key = (h[: n + SPREAD - 1] & ~_POSITION) | np.arange(min(len(h), n + SPREAD - 1), dtype=np.uint64)
    size = 1
    while size < SPREAD:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return (key & _POSITION).astype(np.int64)


class _Strings:
    """Hashes of any strings of a block, as differences of prefix sums over the hashes of its GRAM bytes."""

    _known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, h: np.ndarray, base: int):
        size = 1 << max(10, len(h).bit_length())
        if base not in self._known or len(self._known[base][0]) < len(h) + 1:
            self._known[base] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (base, pow(base, -1, 2**64)))
        up, self.down = self._known[base]
        self.sums = np.append(np.uint64(0), np.cumsum(h * up[: len(h)]))

    def hash(self, start: np.ndarray, length: np.ndarray | int, mark: np.ndarray | int) -> np.ndarray:
        out = (self.sums[start + length - GRAM + 1] - self.sums[start]) * self.down[start]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(mark).astype(np.uint64)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


@dataclass
class Runs:
    """Strings of `length` bytes that follow each other and have the same sampled place p: those that start p - b to p - a."""

    doc: np.ndarray
    p: np.ndarray
    a: np.ndarray
    b: np.ndarray
    h: np.ndarray
    g: np.ndarray


def _hashed(grams: np.ndarray, doc: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, width: int) -> Runs:
    """Runs cut where b - a crosses a multiple of width. h: of bytes that each string of the piece has; g: of all bytes that any has."""
    first = a // width
    n = b // width - first + 1
    which = np.repeat(np.arange(len(p)), n)
    piece = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    doc, p = doc[which], p[which]
    a, b = np.maximum(a[which], piece * width), np.minimum(b[which], piece * width + width - 1)
    h = _Strings(grams, _BASES[0]).hash(p - piece * width, length + 1 - width, piece)
    g = _Strings(grams, _BASES[1]).hash(p - b, length + b - a, a << 8 | b)
    return Runs(doc, p, a, b, h, g)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[Runs]:
    """Of texts laid end to end (offsets: where they start and end), every string of `length` bytes within a text, by sampled place.

    The sampled place of a string is that of the first least hash among its first SPREAD
    places. It depends on the string's bytes alone, so equal strings have it at the same
    distance: what a difference cover grants for a fixed set of residues.
    """
    for at in range(0, int(offsets[-1]), BLOCK):
        lo, hi = np.searchsorted(offsets, [at, at + BLOCK])
        own = np.arange(max(0, lo - 1), min(hi, len(offsets) - 1))
        start = np.maximum(offsets[own], at) - at
        stop = np.minimum(offsets[own + 1] - length + 1, at + BLOCK) - at
        start, stop = start[start < stop], stop[start < stop]
        if not len(start):
            continue
        n = int(stop.max())
        grams = _gram_hashes(data[at : at + n + length + SPREAD])
        leader = _leaders(grams, n)
        new, inside = np.zeros(n + 1, bool), np.zeros(n + 1, np.int8)
        new[1:n] = leader[1:] != leader[:-1]
        new[start] = new[stop] = True
        inside[start] += 1
        inside[stop] -= 1
        cuts = np.flatnonzero(new)
        open_ = np.flatnonzero(np.cumsum(inside)[cuts[:-1]] > 0)
        first, last = cuts[open_], cuts[open_ + 1] - 1
        p = leader[first]
        doc = np.searchsorted(offsets, at + first, side="right") - 1
        found = _hashed(grams, doc, p, p - last, p - first, length, SPREAD)
        found.p += at - offsets[found.doc]
        yield found


def pieces(data: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, width: int) -> Iterator[Runs]:
    """Given runs of one text, cut into pieces of `width` strings at most."""
    order = np.argsort(p - b)
    p, a, b = p[order], a[order], b[order]
    while len(p):
        at = int(p[0] - b[0])
        n = max(1, int(np.searchsorted(p - b, at + BLOCK)))
        grams = _gram_hashes(data[at : int((p[:n] - a[:n]).max()) + length])
        found = _hashed(grams, np.zeros(n, np.int64), p[:n] - at, a[:n], b[:n], length, width)
        found.p += at
        yield found
        p, a, b = p[n:], a[n:], b[n:]


def ranks(strings: np.ndarray) -> np.ndarray:
    """The order of rows of bytes (n, m): symbols of eight bytes are named by rank, then triples of names, and so on upon the names."""
    n, m = strings.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = strings
    _, names = np.unique(wide.view(">u8").astype(np.uint64), return_inverse=True)
    names = names.reshape(n, -1)
    while names.shape[1] > 1:
        padded = np.zeros((n, -(-names.shape[1] // 3) * 3), np.uint64)
        padded[:, : names.shape[1]] = names
        top = padded.max() + np.uint64(1)
        triples = (padded[:, ::3] * top + padded[:, 1::3]) * top + padded[:, 2::3]
        _, names = np.unique(triples, return_inverse=True)
        names = names.reshape(n, -1)
    return names[:, 0]


def _shared(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in order, has in common with the one before; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 4096):
        part = slice(at, min(len(order), at + 4096))
        unlike = strings[order[part]] != strings[order[part.start - 1 : part.stop - 1]]
        out[part] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), strings.shape[1])
    return out


def _matrix(flat: np.ndarray, ends: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Byte strings as rows of a matrix, zeros behind."""
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.uint8)
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)
    out[row, np.repeat(sizes, sizes) - 1 - column if backwards else column] = flat[ends[0] : ends[-1]]
    return out


def repeated(group: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Which strings of each run have an equal in another run of its group: (runs, SPREAD) by distance d to the sampled place.

    right: rows of what follows the sampled place, left: of what precedes it, backwards. The
    sampled suffixes are sorted by group and rank, and so are the preceding bytes. A string at
    distance d is the last d bytes before its sampled place and the length - d bytes from there,
    so equal ones lie in a stretch of either order whose neighbours share as much.
    """
    n = len(group)
    by_right, by_left = np.lexsort((ranks(right), group)), np.argsort(ranks(left), kind="stable")
    ahead, behind = _shared(right, by_right), _shared(left, by_left)
    ahead[1:][group[by_right[1:]] != group[by_right[:-1]]] = -1
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    at_right[by_right] = at_left[by_left] = np.arange(n)
    out = np.zeros((n, SPREAD), bool)
    for d in range(int(a.min()), int(b.max()) + 1):
        own = np.flatnonzero((a <= d) & (d <= b))
        key = np.cumsum(ahead < length - d)[at_right[own]] * (n + 1) + np.cumsum(behind < d)[at_left[own]]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own, d] = count[back] > 1
    return out
