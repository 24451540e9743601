"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, in segments of whole documents, for every word the ascending positions at which it stands.
``phrases`` and ``near`` ask all segments: they start from the postings of a phrase's rarest word there, shifted by its
offset, and intersect them with the shifted postings of the next rarest until all words agree.

Words are held as 64-bit hashes of their bytes; a wrong match would need equal hashes of different words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns, stored
from pinweave.llm.words import LOWER, NOT_ALNUM, expand, gather, hashes, per_document, slices, spans

WINDOW = 10
#: Words of benchmark items that one pass over the index may broadcast, some 100 MB with their windows.
BLOCK_WORDS = 1_000_000

INDEX = "part int, segment int, doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, postings binary"


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the number of words of each document."""
    buf = LOWER[buf]
    starts, ends = spans(buf, offsets, NOT_ALNUM)
    return hashes(buf, starts, ends), np.diff(per_document(starts, offsets))


def build_index(docs: DataFrame, segment_bytes: int = 1 << 20, text: str = "text") -> DataFrame:
    """Postings of every word of every document, written to the shared folder.

    One row is a segment: its documents, the sorted distinct terms, how often each occurs, and the positions of each,
    counted over all words of the segment. A null text has no words; repeated rows are documents of their own.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for s in slices(batch.column(text), segment_bytes):
                h, n = tokens(s.buf, s.offsets)
                order = np.argsort(h, kind="stable").astype(np.int32)
                terms = h[order]
                first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(h) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(h))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([ids.slice(s.lo, s.hi - s.lo).to_pylist()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (terms[first], counts, order))], ["part", "segment", "doc_ids", "n_words", "terms", "counts", "postings"])
                segment += 1

    return stored(docs.mapInArrow(run, INDEX))


class Segment:
    """One row of the index."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.terms, self.counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.size = len(self.postings)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.n_words)])
        # Ascending, as the postings are by term and then position: one search finds a position in any term's list.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.size + self.postings

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The index of each term, -1 if no document has it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the postings of each term."""
        key = term * self.size + position
        at = np.searchsorted(self.keys, key)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, side="right") - 1


class Phrases:
    """The distinct windows of a block of items: a matrix of terms, -1 beyond a short window, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        rows: dict[bytes, set[int]] = {}
        self.item_ids = [x for x, _ in items]
        self.whole: list[np.ndarray] = []
        for k, (_, text) in enumerate(items):
            buf = np.frombuffer(text, np.uint8)
            h, _ = tokens(buf, np.array([0, len(buf)]))
            self.whole.append(h)
            for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                rows.setdefault(h[i : i + window].tobytes(), set()).add(k)
        flat = np.frombuffer(b"".join(rows), np.uint64)
        self.length = np.array([len(r) // 8 for r in rows], np.int64)
        self.owners = [sorted(x) for x in rows.values()]
        self.terms, inverse = np.unique(flat, return_inverse=True)
        self.matrix = np.full((len(rows), window), -1, np.int64)
        row, column = expand(self.length)
        self.matrix[row, column] = inverse

    def search(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence in a segment."""
        none = np.zeros(0, np.int64)
        found = segment.find(self.terms)
        if not len(self.terms) or (found < 0).all():
            return none, none
        alive = np.flatnonzero(((self.matrix < 0) | (found[self.matrix] >= 0)).all(axis=1))
        if not len(alive):
            return none, none
        term = np.where(self.matrix[alive] < 0, -1, found[self.matrix[alive]])
        count = np.where(term < 0, np.iinfo(np.int64).max, segment.counts[term])
        rarest = np.argsort(count, axis=1, kind="stable")
        each = np.arange(len(alive))
        anchor = term[each, rarest[:, 0]]
        n = segment.counts[anchor]
        which = np.repeat(each, n)
        at = gather(segment.postings, segment.first[anchor], n) - rarest[which, 0]
        last = at + self.length[alive][which] - 1
        ok = (at >= 0) & (last < segment.size)
        which, at, last = which[ok], at[ok], last[ok]
        ok = segment.document(at) == segment.document(last)
        which, at = which[ok], at[ok]
        for k in range(1, self.matrix.shape[1]):
            if not len(which):
                break
            offset = rarest[which, k]
            t = term[which, offset]
            ok = (t < 0) | segment.holds(np.maximum(t, 0), at + offset)
            which, at = which[ok], at[ok]
        return alive[which], at

    def around(self, segment: Segment, picked: list[np.ndarray], within: int) -> Iterator[tuple[int, int]]:
        """(item, position) where the first of an item's picked terms has all its others within so many words."""
        for k, terms in enumerate(picked):
            found = segment.find(terms)
            if not len(found) or (found < 0).any():
                continue
            at = segment.postings[segment.first[found[0]] : segment.first[found[0]] + segment.counts[found[0]]]
            doc = segment.document(at)
            lo = np.maximum(at - within, segment.doc_starts[doc])
            hi = np.minimum(at + within, segment.doc_starts[doc + 1] - 1)
            for t in found[1:]:
                ok = np.searchsorted(segment.keys, t * segment.size + hi, side="right") > np.searchsorted(segment.keys, t * segment.size + lo)
                at, lo, hi = at[ok], lo[ok], hi[ok]
            yield from ((k, int(x)) for x in at)

    def rarest(self, counts: dict[int, int], terms: int) -> list[np.ndarray]:
        """For each item its words that are rarest in all documents, on ties the first; words that no document has are left out."""
        out = []
        for whole in self.whole:
            words = [t for t in dict.fromkeys(whole.tolist()) if counts.get(t)]
            out.append(np.array(sorted(words, key=lambda t: counts[t])[:terms], np.uint64))
        return out


def _blocks(items: DataFrame, window: int, block_words: int, text: str) -> Iterator[Phrases]:
    """The items in blocks of bounded size; all of them in one where they are as few as benchmarks are."""
    items = kept_columns(items, {"item_id": "string", text: "string"}).where(F.length(text) > 0)
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", text), F.lit(blocks)) == k) if blocks > 1 else items
        yield Phrases([(r[0], r[1].encode()) for r in part.collect()], window)


HITS = "doc_id bigint, n_words bigint, hits array<struct<s:bigint,e:bigint>>, items array<string>"


#: Tells the rows of documents apart, also those that share a doc_id.
PLACE = ["part", "segment", "row"]


def phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """One row per document: the spans of words in occurrences of the items' windows, and the items they are of.

    An item with fewer words than the window, but not none, is one window. Spans are half-open and do not touch.
    """
    return _phrases(index, items, window, block_words, text).drop(*PLACE)


def _phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    spark = index.sparkSession

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row)
                    docs = len(segment.n_words)
                    spans_, items_ = [[] for _ in range(docs)], [set() for _ in range(docs)]
                    which, at = block.search(segment)
                    if len(which):
                        inside = np.zeros(segment.size + 1, np.int64)
                        np.add.at(inside, at, 1)
                        np.add.at(inside, at + block.length[which], -1)
                        hit = np.cumsum(inside)[:-1] > 0
                        edge = np.zeros(segment.size + 1, dtype=bool)
                        edge[segment.doc_starts] = True
                        before = np.concatenate([[False], hit[:-1]])
                        after = np.concatenate([hit[1:], [False]])
                        begin, stop = np.flatnonzero(hit & (~before | edge[:-1])), np.flatnonzero(hit & (~after | edge[1:])) + 1
                        for d, a, b in zip(segment.document(begin).tolist(), begin.tolist(), stop.tolist(), strict=True):
                            spans_[d].append({"s": a - int(segment.doc_starts[d]), "e": b - int(segment.doc_starts[d])})
                        for d, w in np.unique(np.stack([segment.document(at), which], axis=1), axis=0).tolist():
                            items_[d].update(block.item_ids[k] for k in block.owners[w])
                    place = {"part": pa.array([row["part"]] * docs, pa.int32()), "segment": pa.array([row["segment"]] * docs, pa.int32()), "row": pa.array(range(docs), pa.int32())}
                    yield pa.RecordBatch.from_pydict(place | {"doc_id": pa.array(segment.doc_ids, pa.int64()), "n_words": pa.array(segment.n_words), "hits": pa.array(spans_, _SPANS), "items": pa.array([sorted(x - {None}) for x in items_], pa.list_(pa.string()))})

        return run

    found, blocks = None, 0
    for block in _blocks(items, window, block_words, text):
        rows = index.mapInArrow(search(spark.sparkContext.broadcast(block)), f"part int, segment int, row int, {HITS}")
        found, blocks = rows if found is None else found.unionByName(rows), blocks + 1
    if blocks > 1:
        found = found.groupBy(*PLACE, "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return found


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def near(index: DataFrame, items: DataFrame, terms: int = 4, within: int = 20, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """(doc_id, item_id, position): an item's rarest words stand within so many words of the rarest one, in any order.

    Words are the rarer the fewer places of the whole index they have, so a document is judged by its own words alone,
    whichever others share its segment. Words that no document has are passed over; an item of fewer words is near
    where all of these are. Null and empty items are nowhere; items given twice are found twice.
    """
    return _near(index, items, terms, within, block_words, text).drop(*PLACE)


def _near(index: DataFrame, items: DataFrame, terms: int = 4, within: int = 20, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    spark = index.sparkSession

    def count(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row)
                    at = segment.find(held.value.terms)
                    own = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(held.value.terms[own].view(np.int64)), pa.array(segment.counts[at[own]])], ["term", "n"])

        return run

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, picked = held.value
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row)
                    got = list(block.around(segment, picked, within))
                    doc = segment.document(np.array([p for _, p in got], np.int64)).tolist()
                    place = {"part": pa.array([row["part"]] * len(got), pa.int32()), "segment": pa.array([row["segment"]] * len(got), pa.int32()), "row": pa.array(doc, pa.int32())}
                    yield pa.RecordBatch.from_pydict(place | {"doc_id": pa.array([segment.doc_ids[d] for d in doc], pa.int64()), "item_id": pa.array([block.item_ids[k] for k, _ in got], pa.string()), "position": pa.array([p - int(segment.doc_starts[d]) for (_, p), d in zip(got, doc, strict=True)], pa.int64())})

        return run

    found = None
    for block in _blocks(items, WINDOW, block_words, text):
        # At most a row for each distinct word of the block, whose number is bounded.
        counts = index.mapInArrow(count(spark.sparkContext.broadcast(block)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        picked = block.rarest({r["term"] % (1 << 64): r["n"] for r in counts.collect()}, terms)
        rows = index.mapInArrow(search(spark.sparkContext.broadcast((block, picked))), "part int, segment int, row int, doc_id bigint, item_id string, position bigint")
        found = rows if found is None else found.unionByName(rows)
    return found


def covered_words(hits: str) -> Column:
    """Words in the union of an array of spans."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(hits), state, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document.

    Null texts have no words on either side; no items leave every document clean; repeated rows each have their row. With
    ``proximity`` n_near follows, the number of items whose rarest words stand near each other; it decides nothing.
    """
    index = build_index(docs)
    found = _phrases(index, items, window)
    columns = ["doc_id", "n_words", covered_words("hits").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (covered_words("hits") > 0).alias("contaminated")]
    if proximity:
        close = _near(index, items).groupBy(*PLACE).agg(F.count_distinct("item_id").alias("n_near"))
        found = found.join(close, PLACE, "left")
        columns.append(F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return found.select(*columns)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, of documents without an occurrence of an item's window.

    Rows with one doc_id go together; a row without doc_id stays.
    """
    hit = contamination(docs, items, window).where("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item, n, list_slice(words, i, i + n - 1) AS window_ FROM (SELECT item, words, least({WINDOW}, len(words)) AS n, unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (SELECT k, i, n, list_slice(words, i, i + n - 1) AS window_ FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
m AS (SELECT k, i, g.n, item FROM g JOIN w ON g.n = w.n AND g.window_ = w.window_),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM m) GROUP BY k),
tw AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
bw AS (SELECT r, item, w, min(i) AS first FROM (SELECT r, item, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT row_number() OVER () AS r, item, words FROM b)) GROUP BY ALL),
pk AS (SELECT * FROM (SELECT r, item, w, row_number() OVER (PARTITION BY r ORDER BY c, first) AS n FROM bw JOIN (SELECT w, count(*) AS c FROM tw GROUP BY w) USING (w)) WHERE n <= 4),
an AS (SELECT r, k, i, most FROM pk JOIN tw USING (w) JOIN (SELECT r, max(n) AS most FROM pk GROUP BY r) USING (r) WHERE n = 1),
nr AS (SELECT an.r, an.k, an.i FROM an JOIN pk ON pk.r = an.r JOIN tw ON tw.w = pk.w AND tw.k = an.k AND abs(tw.i - an.i) <= 20 GROUP BY an.r, an.k, an.i, most HAVING count(DISTINCT pk.n) = most),
nn AS (SELECT k, count(DISTINCT item) AS n_near FROM nr JOIN pk USING (r) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h ON h.k = d.k LEFT JOIN t ON t.k = d.k LEFT JOIN nn ON nn.k = d.k
"""
