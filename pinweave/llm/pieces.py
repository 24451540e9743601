"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The new distinct chunks of a batch are concatenated and indexed by a suffix array; each piece of the vocabulary is
looked up by binary search, and its range of suffixes gives an edge for every occurrence. The edges, sorted by the
position they end at, are relaxed from left to right: the encoding of a prefix ends in the one edge whose token may
stand beside the last token of the encoding before it. Two tokens may stand side by side if merging their joint text
gives just these two. This is exact for byte-pair encoding, where a shortest-path rule would not be.

A text is cut into chunks where no piece of the vocabulary has the two bytes at the cut beside each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pinweave.llm.shared import kept_columns
from pinweave.llm.words import Known, Runs, Slice, Table, cuts, gather, hashes, mix, slices

SPACE = "▁".encode()
#: Follows each chunk in the concatenated text; no UTF-8 text has it.
_END = 0xFF
#: Pairs of tokens of which a worker keeps whether they may stand side by side, and bytes of new chunks indexed at a time.
PAIRS, INDEX_BYTES = 500_000, 1 << 18


class Index:
    """Suffix array over chunks, each followed by _END; suffixes are compared to the end of their chunk."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.n = n
        stop = np.flatnonzero(text == _END)
        left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
        key = np.zeros(n, np.uint64)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in range(8):
            key |= np.where(left > k, padded[k : k + n], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        self.suffixes = np.argsort(key, kind="stable")
        self.keys = key[self.suffixes]
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        rank = np.empty(n, np.int64)
        rank[self.suffixes] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        reach = 8
        while reach < depth:
            # A place beyond a chunk's end ranks lowest.
            nxt = np.where(left > reach, rank[np.minimum(np.arange(n) + reach, n - 1)] + 1, 0)
            order = np.lexsort((nxt, rank))
            first, second = rank[order], nxt[order]
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            self.suffixes = order
            rank = np.empty(n, np.int64)
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            reach *= 2
        self.left = left
        self.rank = rank

    def ranges(self, blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern, given as rows of 8-byte blocks, the half-open range of suffixes that begin with it."""
        keys = np.sort(self.keys)
        width = blocks.shape[1]
        lo, hi = np.zeros(len(blocks), np.int64), np.full(len(blocks), self.n, np.int64)
        for j in range(width - 1, -1, -1):
            size = np.clip(lengths - 8 * j, 0, 8)
            use = np.flatnonzero(size > 0)
            block = blocks[use, j]
            rest = (np.uint64(8) - size[use].astype(np.uint64)) * np.uint64(8)
            top = block | np.where(rest > 0, (np.uint64(1) << np.minimum(rest, np.uint64(63))) - np.uint64(1), np.uint64(0))
            a, b = np.searchsorted(keys, block, side="left"), np.searchsorted(keys, top, side="right")
            more = np.flatnonzero((lengths[use] > 8 * (j + 1)) & (b > a))
            if len(more):
                # Among suffixes with this block, those whose rest lies in the range of the pattern's rest.
                tail_lo, tail_hi = lo[use[more]], hi[use[more]]
                a2, b2 = self._bisect(a[more], b[more], tail_lo), self._bisect(a[more], b[more], tail_hi)
                a[more], b[more] = a2, b2
            lo[use], hi[use] = a, b
        return lo, hi

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose suffix, 8 bytes on, has at least the rank bound."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            go = lo < hi
            if not go.any():
                return lo
            mid = (lo + hi) // 2
            at = self.suffixes[np.minimum(mid, self.n - 1)]
            value = np.where(self.left[at] > 8, self.rank[np.minimum(at + 8, self.n - 1)], -1)
            less = go & (value < bound)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(go & ~less, mid, hi)


class Pieces:
    """A byte-pair model of the sentencepiece library: its pieces and their ranks, read through the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.rank: dict[bytes, float] = {}
        self.of: dict[bytes, int] = {}
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        self.output: list[bytes] = [b""] * size
        for k in range(size):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.output[k] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                raw = piece.encode()
                self.of[raw], self.rank[raw] = k, -sp.get_score(k)
                self.output[k] = raw.replace(SPACE, b" ")
        self.ids = np.array(list(self.of.values()), np.int64)
        raws = list(self.of)
        self.lengths = np.array([len(x) for x in raws], np.int64)
        self.depth = int(self.lengths.max())
        width = -(-self.depth // 8)
        self.blocks = np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in raws), ">u8").reshape(-1, width).astype(np.uint64)
        self.beside = np.zeros((256, 256), dtype=bool)
        for x in raws:
            b = np.frombuffer(x, np.uint8)
            self.beside[b[:-1], b[1:]] = True
        inner = {c for x in raws for c in x.decode() if len(x.decode()) > 1}
        self.simple = all(c.encode() in self.of for c in inner)
        # Before a space that follows another character there is a cut if no piece goes on from one to the other.
        self.space_cut = not any(SPACE in x.lstrip(b"\xe2\x96\x81") for x in raws)
        if not self.simple or not self.space_cut:
            raise ValueError("this model joins characters that it has no piece for, or words")
        self.out_start = np.concatenate([[0], np.cumsum([len(x) for x in self.output])])
        self.out_bytes = np.frombuffer(b"".join(self.output), np.uint8)
        self.raw = {k: x for x, k in self.of.items()}
        self.path, self.known = path, Known(np.int32)
        self.pairs, self.pair_ok = Table(), Runs(bool)

    def merge(self, text: str) -> list[bytes]:
        """Byte-pair merging of a short text: the best-ranked pair first, the leftmost on ties."""
        parts = [c.encode() for c in text]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of token ids may stand side by side; answers are kept."""
        key = mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        key[key == 0] = 1
        if self.pairs.size > PAIRS:
            self.pairs, self.pair_ok = Table(), Runs(bool)
        at, new = self.pairs.ids(key)
        if len(new):
            ok = [self.merge((self.raw[a] + self.raw[b]).decode()) == [self.raw[a], self.raw[b]] for a, b in zip(left[new].tolist(), right[new].tolist(), strict=True)]
            self.pair_ok.put(np.array(ok, bool), np.ones(len(ok), np.int64))
        return self.pair_ok.values[at]

    def chunks(self, s: Slice) -> np.ndarray:
        """Offsets in a slice where a chunk starts."""
        b, n = s.buf, len(s.buf)
        start = cuts(s.offsets, n)[:n].copy()
        if n > 1:
            before, after = b[:-1], b[1:]
            free = ~self.beside[np.where(before == 0x20, SPACE[-1], before), np.where(after == 0x20, SPACE[0], after)]
            start[1:] |= free & ((after & 0xC0) != 0x80)
            start[1:] |= (after == 0x20) & (before != 0x20) & (before != SPACE[-1])
        return np.flatnonzero(start)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents, one after the other, and the number of each document."""
        sizes = np.diff(s.offsets)
        if not len(s.buf):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        starts = self.chunks(s)
        ends = np.append(starts[1:], len(s.buf))
        h = hashes(s.buf, starts, ends)
        # A chunk that opens a document has other ids than the same bytes elsewhere.
        opening = np.isin(starts, s.offsets[:-1][sizes > 0])
        which, new = self.known.find(s.buf, starts, ends, np.where(opening, mix(h), h))
        for lo, hi in self._groups(ends[new] - starts[new]):
            self._learn(s.buf, starts[new[lo:hi]], ends[new[lo:hi]], opening[new[lo:hi]])
        if not self.known.right(which, s.buf, starts, ends):
            return self._whole(s)
        ids, lengths = self.known.ids.take(which)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, s.offsets)])

    def _whole(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, each document by the library at once."""
        from sentencepiece import SentencePieceProcessor

        raw, library = s.buf.tobytes(), SentencePieceProcessor(model_file=self.path)
        each = [library.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
        return np.fromiter((i for x in each for i in x), np.int32), np.array([len(x) for x in each], np.int64)

    @staticmethod
    def _groups(sizes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of new chunks of some ``INDEX_BYTES`` each: the index and its edges take 200 times the room of their text."""
        group = (np.cumsum(sizes) - sizes) // INDEX_BYTES
        edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(sizes)]]) if len(sizes) else np.zeros(1, np.int64)
        return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, opening: np.ndarray) -> None:
        parts = [(SPACE if o else b"") + buf[a:b].tobytes().replace(b" ", SPACE) for a, b, o in zip(starts.tolist(), ends.tolist(), opening.tolist(), strict=True)]
        tokens, counts = self.relax(np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8))
        self.known.ids.put(tokens, counts)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of every occurrence of a piece, and of every character that is no piece (token -1)."""
        index = Index(text, self.depth)
        lo, hi = index.ranges(self.blocks, self.lengths)
        n = np.maximum(hi - lo, 0)
        start = gather(index.suffixes, lo, n)
        which = np.repeat(np.arange(len(n)), n)
        end, token = start + self.lengths[which], self.ids[which]
        first = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _END))
        lead = text[first]
        size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.zeros(len(text), dtype=bool)
        width = np.zeros(len(text), np.int64)
        width[first] = size
        single[start[end - start == width[start]]] = True
        lone = ~single[first]
        return np.concatenate([start, first[lone]]), np.concatenate([end, (first + size)[lone]]), np.concatenate([token, np.full(int(lone.sum()), -1)])

    def relax(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks, one after the other, and the number of each."""
        start, end, token = self.edges(text)
        stop = np.flatnonzero(text == _END)
        chunk_start = np.concatenate([[0], stop[:-1] + 1])
        depth = end - chunk_start[np.searchsorted(stop, start)]
        order = np.argsort(depth, kind="stable")
        start, end, token, depth = start[order], end[order], token[order], depth[order]
        # At each place the last token of the encoding up to it: -3 unreached, -2 a chunk's start, -1 an unknown character.
        last, back = np.full(len(text) + 1, -3, np.int64), np.zeros(len(text) + 1, np.int64)
        last[chunk_start] = -2
        cut = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(depth) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            x, y, t = start[a:b], end[a:b], token[a:b]
            prev = last[x]
            ok = prev > -3
            check = np.flatnonzero((prev >= 0) & (t >= 0))
            ok[check] = self.fits(prev[check], t[check])
            last[y[ok]], back[y[ok]] = t[ok], x[ok]
        at, live = stop.copy(), np.arange(len(stop))
        chunks, places, tokens = [], [], []
        while True:
            go = at > chunk_start[live]
            at, live = at[go], live[go]
            if not len(at):
                break
            chunks.append(live)
            places.append(at)
            tokens.append(last[at])
            at = back[at]
        none = np.zeros(0, np.int64)
        chunk, place, token = (np.concatenate(x) if x else none for x in (chunks, places, tokens))
        order = np.argsort(place, kind="stable")
        chunk, place, token = chunk[order], place[order], token[order]
        begin = back[place]
        size = np.where(token < 0, place - begin, 1)
        at = gather(np.arange(len(text)), begin, size)
        out = np.where(np.repeat(token < 0, size), self.byte_ids[text[at]], np.repeat(token, size))
        return out.astype(np.int32), np.bincount(np.repeat(chunk, size), minlength=len(stop))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of documents, one after the other, and the offset of each; the opening space is taken off."""
        sizes = np.diff(self.out_start)[ids]
        out = gather(self.out_bytes, self.out_start[ids], sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = total[np.concatenate([[0], np.cumsum(counts)])]
        has = np.flatnonzero(counts)
        drop = at[has][out[at[has]] == 0x20] if len(out) else at[:0]
        keep = np.ones(len(out), dtype=bool)
        keep[drop] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One model for a worker process."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", slice_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, ids array<int>) of every document.

    A null or empty text has no ids; characters without a piece become their bytes' pieces. Rows come out as they came in.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for s in slices(batch.column(text), slice_bytes):
                ids, counts = m.encode(s)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.lo, s.hi - s.lo), pa.ListArray.from_arrays(at, pa.array(ids))], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    encoded = kept_columns(encoded, {"doc_id": "bigint", "ids": "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            column = batch.column("ids")
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            out, at = m.decode(ids, counts)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", slice_bytes: int = 1 << 21, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit) and whether decoding gives the text back.

    ``with_ids`` adds the ids. Null and empty texts have none; rows come out as they came in.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for s in slices(batch.column(text), slice_bytes):
                ids, counts = m.encode(s)
                out, at = m.decode(ids, counts)
                edge = 4 * np.concatenate([[0], np.cumsum(counts)])
                data = memoryview(ids.astype("<u4").tobytes())
                back, own = memoryview(out.tobytes()), memoryview(s.buf.tobytes())
                crc = [crc32(data[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                same = [back[a:b] == own[c:d] for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
                found = {"doc_id": batch.column("doc_id").slice(s.lo, s.hi - s.lo), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())}
                if with_ids:
                    found["ids"] = pa.ListArray.from_arrays(pa.array((edge // 4).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(found)

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids)
