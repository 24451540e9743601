"""Word spans, word hashes and id tables computed on whole Arrow text buffers.

Everything here is vectorised over the bytes of a slice of documents, so no Python object is made per word.  A slice
holds whole documents and about ``limit`` bytes; a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``[\x20\x09-\x0D]``
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``: all ASCII but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

#: Upper-case A-Z to lower case, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Spans longer than this are hashed one by one.
LONG = 128
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Slice:
    """Consecutive documents of a batch: rows ``lo:hi``, their bytes and the offset of each document in these."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[Slice]:
    """The documents of a string column in order; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def cuts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Boolean of length size + 1, true where a document starts or ends."""
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    return edge


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, none crossing a document's edge."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separator[buf]
    edge = cuts(offsets, len(buf))
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def per_document(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the number of spans before it, with the total last."""
    return np.searchsorted(starts, offsets, side="left")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of a buffer on as one number, zeros beyond its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands; never 0.

    Eight bytes at a time go through a bijection, so two spans of one size that differ in one such block differ in it;
    spans over ``LONG`` bytes take a cryptographic hash.
    """
    sizes = ends - starts
    number = eights(buf)
    h = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    done = 0
    while len(at):
        h[at] = mix(h[at] ^ number[starts[at] + done] & _MASK[np.minimum(sizes[at] - done, 8)])
        done += 8
        at = at[sizes[at] > done]
    for k in np.flatnonzero(sizes > LONG).tolist():
        h[k] = int.from_bytes(blake2b(buf[starts[k] : ends[k]], digest_size=8).digest(), "little")
    h[h == 0] = 1
    return h


def same_bytes(buf: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each span of one buffer has the bytes of a span of this size in another buffer."""
    one, two = eights(buf), eights(other)
    same = np.ones(len(sizes), dtype=bool)
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    done = 0
    while len(at):
        same[at] &= (one[starts[at] + done] ^ two[other_starts[at] + done]) & _MASK[np.minimum(sizes[at] - done, 8)] == 0
        done += 8
        at = at[sizes[at] > done]
    for k in np.flatnonzero(sizes > LONG).tolist():
        same[k] = np.array_equal(buf[starts[k] : starts[k] + sizes[k]], other[other_starts[k] : other_starts[k] + sizes[k]])
    return same


class Table:
    """Open-addressing map from non-zero 64-bit hashes to 0, 1, 2, ... in the order of insertion."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 if it has none."""
        found = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        np.copyto(found, self.values[slot], where=hit)
        left = np.flatnonzero(~hit & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            key = self.keys[slot]
            hit = key == h[left]
            found[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], slot[go]
        return found

    def add(self, h: np.ndarray) -> np.ndarray:
        """Puts in distinct hashes that it does not hold; returns their values."""
        new = np.arange(self.size, self.size + len(h))
        self.size += len(h)
        if 2 * self.size > len(self.keys):
            used = self.keys != 0
            keys, values = np.concatenate([self.keys[used], h]), np.concatenate([self.values[used], new])
            self.bits = max(self.bits + 1, int(4 * self.size).bit_length() - 1)
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            self._put(keys, values)
        else:
            self._put(h, new)
        return new

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each hash, new ones put in; and for each new one the index of its first occurrence."""
        found = self.find(h)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found, missing
        new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
        found[missing] = self.add(new)[which]
        return found, missing[first]


def expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: which run each element is in, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - starts[run]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(total)]


class Runs:
    """Runs of values, one after the other, numbered in the order in which they are put in."""

    def __init__(self, kind: type):
        self.values, self.used = np.zeros(1 << 12, kind), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.starts.nbytes + self.sizes.nbytes

    def put(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = _room(self.values, self.used, len(values))
        self.starts, self.sizes = _room(self.starts, self.count, len(sizes)), _room(self.sizes, self.count, len(sizes))
        self.values[self.used : self.used + len(values)] = values
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.used, self.count = self.used + len(values), self.count + len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers, one after the other, and their sizes."""
        sizes = self.sizes[which]
        return gather(self.values, self.starts[which], sizes), sizes


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(values):
        return values
    return np.concatenate([values[:used], np.zeros(max(used, more) + more, values.dtype)])


class Known:
    """Distinct spans seen so far with their bytes and the ids that they were given.

    A span is found by its hash, and its bytes are compared. Beyond ``limit`` bytes everything is forgotten.
    """

    def __init__(self, kind: type, limit: int = 96 << 20):
        self.kind, self.limit = kind, limit
        self._clear()

    def _clear(self) -> None:
        self.table, self.ids, self.text = Table(), Runs(self.kind), Runs(np.uint8)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and the indices of spans of new numbers, to be put in with ``put``."""
        if self.ids.nbytes + self.text.nbytes + self.table.keys.nbytes + self.table.values.nbytes > self.limit:
            self._clear()
        which, new = self.table.ids(h)
        if len(new):
            sizes = ends[new] - starts[new]
            self.text.put(gather(buf, starts[new], sizes), sizes)
        return which, new

    def right(self, which: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether all spans have the bytes of what they were found as; not so where different spans have one hash."""
        sizes = ends - starts
        return np.array_equal(sizes, self.text.sizes[which]) and bool(same_bytes(buf, starts, self.text.values, self.text.starts[which], sizes).all())
