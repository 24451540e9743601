"""Token ids in wavelet-matrix shards: one compressed row per shard with access, rank and select on the bit planes.

A shard holds the ids of consecutive documents. Its matrix has one bit plane per bit of the largest id, the most
significant first; after each plane the ids are split stably into those with a 0 and those with a 1. The planes and the
ones before each of their blocks are all that is stored: ids, counts and occurrences are read with rank and select, also
of many places at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns, stored
from pinweave.llm.words import LOWER, Known, Slice, cuts, hashes, slices
from pinweave.ship import ship

END_ID = 2


class WaveletMatrix:
    """Succinct sequence of non-negative integers below 2 ** bits."""

    BLOCK = 512

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self._ranks = n, planes, ranks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (values >> values.dtype.type(level)) & values.dtype.type(1) != 0
            planes.append(np.packbits(one, bitorder="little"))
            if level:
                values = np.concatenate([values[~one], values[one]])
        return cls(len(values), planes)

    @property
    def ranks(self) -> list[np.ndarray]:
        """For each plane the ones before every block of BLOCK bits, with the total last."""
        if self._ranks is None:
            self._ranks = []
            step = self.BLOCK // 8
            for plane in self.planes:
                ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        block, rest = divmod(i, self.BLOCK)
        part = self.planes[level][block * self.BLOCK // 8 : (i + 7) // 8].copy()
        if i % 8:
            part[-1] &= (1 << (i % 8)) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        """The value at i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3] >> (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.n - int(self.ranks[level][-1]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _ones_at(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each of many places."""
        block = at // self.BLOCK
        words = np.pad(self.planes[level], (0, -len(self.planes[level]) % 8)).view("<u8")
        out = self.ranks[level][block].astype(np.int64)
        for k in range(self.BLOCK // 64):
            word = block * (self.BLOCK // 64) + k
            bits = np.clip(at - 64 * word, 0, 64)
            own = np.flatnonzero(bits)
            mask = np.where(bits[own] == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits[own], 63).astype(np.uint64)) - np.uint64(1))
            out[own] += np.bitwise_count(words[word[own]] & mask)
        return out

    def access_all(self, at: np.ndarray) -> np.ndarray:
        """The values at many places."""
        value = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            one = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            ones = self._ones_at(level, at)
            at = np.where(one, self.n - int(self.ranks[level][-1]) + ones, at - ones)
            value = value << 1 | one
        return value

    def count_all(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often each value occurs from lo up to hi of its own."""
        for level in range(len(self.planes)):
            one = values >> (len(self.planes) - 1 - level) & 1 == 1
            zeros = self.n - int(self.ranks[level][-1])
            a, b = self._ones_at(level, lo), self._ones_at(level, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value < 0 or value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                zeros = self.n - int(self.ranks[level][-1])
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before position i."""
        lo, hi = self._range(value, 0, min(max(i, 0), self.n))
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The position of occurrence k (from 0) of value; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            zeros = self.n - int(self.ranks[level][-1])
            one = value >> (len(self.planes) - 1 - level) & 1
            i = self._nth(level, i - zeros if one else i, bool(one))
        return i

    def _nth(self, level: int, k: int, one: bool) -> int:
        """The position of the k-th (from 0) one or zero of a plane."""
        before = self.ranks[level]
        if not one:
            before = np.minimum(np.arange(len(before)) * self.BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * self.BLOCK // 8 : (block + 1) * self.BLOCK // 8], bitorder="little")
        bits = bits[: min(self.BLOCK, self.n - block * self.BLOCK)]
        return block * self.BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]

    def values(self) -> np.ndarray:
        """All values in order: the stable splits are undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(np.count_nonzero(one))
            bit = kind(1 << (len(self.planes) - 1 - level))
            up = np.empty_like(out)
            up[~one] = out[:zeros]
            up[one] = out[zeros:] | bit
            out = up
        return out


_SPACE = re.compile(r"\s")
_BLANKS = [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]
#: First bytes of characters that are surely no white space: none of ASCII's, nor of the blocks that hold any.
_SOLID = np.ones(256, dtype=bool)
_SOLID[[*_BLANKS, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = (LOWER >= 0x61) & (LOWER <= 0x7A)
_ALNUM = _LETTER.copy()
_ALNUM[0x30:0x3A] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[0x21:0x7F] = True
_PUNCT &= ~_ALNUM
_PUNCT[0x27] = False  # an apostrophe may join the letters after it


class ByteBpe:
    """Encodes documents with a byte-level BPE of the tokenizers library.

    A text is cut only where the tokenizer's own splitting rule always cuts, whatever stands around; each distinct chunk
    goes through the library once, and documents are put together from the chunks' ids.
    """

    SPECIAL = b"<|endoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known = Known(self.kind)

    def chunks(self, s: Slice) -> np.ndarray:
        """Offsets in the slice where a chunk starts."""
        b, n = s.buf, len(s.buf)
        edge = cuts(s.offsets, n)
        start = edge[:n].copy()
        if n > 1:
            here, after, same = b[:-1], b[1:], ~edge[1:-1]
            wide = np.zeros(n, dtype=bool)  # ends a two-byte letter
            wide[1:] = (here == 0xC3) & (after != 0x97) & (after != 0xB7)
            solid = _SOLID[after] & same
            start[:-1] |= (here == 0x20) & solid
            alnum, punct = _ALNUM[b], _PUNCT[b]
            start[1:] |= ((alnum | wide)[:-1] & punct[1:] | punct[:-1] & alnum[1:]) & same
            line = np.flatnonzero((here == 0x0A) & solid)
            line = line[line > 0]
            line = line[(alnum | punct | wide)[line - 1] & ~edge[line]]
            start[line] = True
            start[line + 1] = True
        return np.flatnonzero(start)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents, one after the other, and the number of each document."""
        raw = s.buf.tobytes()
        if self.SPECIAL in raw:
            return self._whole(raw, s.offsets)
        starts = self.chunks(s)
        ends = np.append(starts[1:], len(raw))
        which, new = self.known.find(s.buf, starts, ends, hashes(s.buf, starts, ends))
        if len(new):
            self._learn(raw, starts[new], ends[new])
        if not self.known.right(which, s.buf, starts, ends):
            return self._whole(raw, s.offsets)
        ids, lengths = self.known.ids.take(which)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, s.offsets)])

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, each document by the library at once."""
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter((i for x in each for i in x), self.kind), np.array([len(x) for x in each], np.int64)

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Puts in the ids of new chunks, whose values are the last of the table in this order."""
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = [k for k, x in enumerate(texts) if not _SPACE.search(x, 1) and (x[0] == " " or not x[0].isspace())]
        each: list = [None] * len(texts)
        ids = self.tokenizer.encode("\n".join(texts[k] for k in plain), add_special_tokens=False).ids
        parts = np.array(ids, self.kind)
        at = np.flatnonzero(parts == self.newline[0])
        if len(at) == len(plain) - 1:
            for k, x in zip(plain, np.split(parts, at), strict=True):
                each[k] = x
            for k in plain[1:]:
                each[k] = each[k][1:]
        rest = [k for k, x in enumerate(each) if x is None]
        for k, x in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            each[k] = np.array(x.ids, self.kind)
        self.known.ids.put(np.concatenate(each), np.array([len(x) for x in each], np.int64))


SHARD = "part int, shard int, bits int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, planes array<binary>, ranks array<binary>"


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Encodes (doc_id, text) and writes the shards, in ascending (doc_id, text) order, to the shared folder.

    Returns the shards read back: ``part`` and ``shard`` in this order follow doc_id. A null text is empty, a null doc_id
    comes first, repeated rows are all kept, an empty table has no shards. A shard ends with the document in which it
    reaches ``shard_tokens``, so a longer document has a shard of its own.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", "text": "string"})
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        bpe = _encoder(vocabulary)
        ids, doc_ids, lengths, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, lengths, size, shard
            values = np.concatenate(ids)
            matrix = WaveletMatrix.build(values, bpe.bits)
            row = {"part": part, "shard": shard, "bits": bpe.bits, "n_tokens": len(values), "doc_ids": doc_ids, "lengths": lengths, "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.astype("<u4").tobytes() for r in matrix.ranks]}
            ids, doc_ids, lengths, size, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text")):
                got, counts = bpe.encode(s)
                ends = np.cumsum(counts)
                ids.append(np.insert(got, ends, bpe.kind(end_id)))
                doc_ids += keys[s.lo : s.hi]
                lengths += (counts + 1).tolist()
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(encode, SHARD))


_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("bits", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
_encoders: dict[str, ByteBpe] = {}


def _encoder(vocabulary: str) -> ByteBpe:
    """One encoder for a worker process, so that chunks seen in earlier tasks need no second encoding."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ByteBpe(vocabulary)
    return _encoders[vocabulary]


def load(row: dict) -> WaveletMatrix:
    """The matrix of a shard's row, with the ranks that stand there."""
    return WaveletMatrix(row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]])


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, first_id and n_first of every document, read from the shards' bit planes.

    first_id is the first id, n_first how often the document has it; both come from access and rank alone.
    """
    ship(shards.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = load(row)
                data = matrix.values().astype("<u4").tobytes()
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                first = matrix.access_all(starts)
                own = matrix.count_all(first, starts, ends)
                view = memoryview(data)
                crc = [crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * n, pa.int32()), "shard": pa.array([row["shard"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "first_id": pa.array(first), "n_first": pa.array(own)})

    each = shards.mapInArrow(read, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint, n_first bigint")
    # One row per shard, of a million ids or more: the running total over them is small beside the corpus.
    sizes = shards.select("part", "shard", "n_tokens")
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = sizes.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("inner"))
    first = inner.join(base, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("first"))
    return each.join(first, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_first")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of a token id per shard, from rank alone; 0 for an id that no document has, no row without shards.

    Documents with null or empty texts hold but their end id.
    """
    ship(shards.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "shard": row["shard"], "n": load(row).rank(token, row["n_tokens"])}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]))

    return shards.mapInArrow(count, "part int, shard int, n bigint")
