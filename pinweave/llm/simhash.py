"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most four of 64 bits differ in at most one bit of some third of the bits (21 or 22 of
them), and in at most two of some half. On such a part the anchors are the words of a covering code of radius 1: a
Hamming code on 2**r - 1 of its bits, every value on the others. Each fingerprint has one anchor within the radius, its
home; it is copied to every anchor within radius plus threshold. Both members of a near pair then meet at the home of
either, where they are compared in full.

What two texts have in common is not exact in 64 bits: of texts whose sets of word shingles are alike to 0.8 most are further
apart. ``similar`` therefore counts shingles: links of fingerprints are proposals, and a join by the shingles finds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.components import components
from pinweave.llm.jaccard import jaccard_components
from pinweave.llm.shared import kept_columns, stored
from pinweave.llm.words import BLANK, LOWER, per_document, slices, spans
from pinweave.ship import ship

BITS, DISTANCE, SEED, SHINGLE = 64, 4, 42, 4


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, fp long): bit k of fp is set if it is set in over half of the XXH64 (seed 42) of the word shingles.

    A text with fewer words has one shingle of all of them; a text with none, or null, has fingerprint 0.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(LOWER[s.buf], s.offsets, shingle) for s in slices(batch.column(text))]
            values = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


def fingerprint(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of the documents in a buffer."""
    from xxhash import xxh64_intdigest

    starts, ends = spans(buf, offsets, BLANK)
    first = per_document(starts, offsets)
    words = np.diff(first)
    # All words joined by single spaces: a shingle is a slice of this.
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    inside = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    joined[inside] = buf[~BLANK[buf]]
    data = joined.tobytes()
    take = np.minimum(words, shingle)
    number = np.where(words > 0, words - take + 1, 0)
    total = np.concatenate([[0], np.cumsum(number)])
    begin = np.repeat(first[:-1] - total[:-1], number) + np.arange(total[-1])
    stop = begin + np.repeat(take, number) - 1
    a, b = at[begin].tolist(), (at[stop] + sizes[stop]).tolist()
    h = np.fromiter((xxh64_intdigest(data[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    out = np.zeros(len(words), np.uint64)
    has = np.flatnonzero(number)
    if len(has):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, total[has], axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > number[has, None], axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64)[:, 0]
    return out


@lru_cache(maxsize=8)
def covering(parts: int) -> list[tuple[np.ndarray, int, list[np.ndarray], int]]:
    """For each part of the 64 bits: its bit positions, r, the error patterns by syndrome, and the threshold there."""
    out = []
    edges = np.linspace(0, BITS, parts + 1).astype(int).tolist()
    for k in range(parts):
        size, threshold = edges[k + 1] - edges[k], DISTANCE // parts
        r = (size + 1).bit_length() - 1
        inner = (1 << r) - 1
        syndrome = np.array([i + 1 if i < inner else 0 for i in range(size)])
        table: list[list[int]] = [[] for _ in range(1 << r)]
        for weight in range(threshold + 2):
            for bits in combinations(range(size), weight):
                s = 0
                for i in bits:
                    s ^= int(syndrome[i])
                table[s].append(sum(1 << i for i in bits))
        out.append((edges[k], r, [np.array(t, np.uint64) for t in table], size))
    return out


def _syndromes(part: np.ndarray, r: int) -> np.ndarray:
    """Which single bit of the Hamming part, counted from 1, is off its code word; 0 if none is."""
    inner = (1 << r) - 1
    s = np.zeros(len(part), np.int64)
    for j in range(r):
        mask = sum(1 << (i - 1) for i in range(1, inner + 1) if i >> j & 1)
        s |= (np.bitwise_count(part & np.uint64(mask)).astype(np.int64) & 1) << j
    return s


def homes(fp: np.ndarray, parts: int) -> list[np.ndarray]:
    """The anchor of each fingerprint in each part."""
    out = []
    for edge, r, _, size in covering(parts):
        part = fp >> np.uint64(edge) & np.uint64((1 << int(size)) - 1)
        s = _syndromes(part, r)
        out.append(part ^ np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0)))
    return out


def copies(fp: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, index of the fingerprint, anchor) for each anchor within radius plus threshold."""
    for k, (edge, r, table, size) in enumerate(covering(parts)):
        part = fp >> np.uint64(edge) & np.uint64((1 << int(size)) - 1)
        s = _syndromes(part, r)
        for value in np.unique(s):
            own = np.flatnonzero(s == value)
            yield k, np.repeat(own, len(table[value])), (part[own][:, None] ^ table[value]).ravel()


def _links(home: np.ndarray, near: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one anchor: a search in which what is reached is not compared again."""
    unseen = np.unique(np.concatenate([home, near]))
    reached: set[int] = set()
    a, b = [], []
    for x in np.unique(home):
        if int(x) in reached:
            continue
        stack = [x]
        while stack and len(unseen):
            y = stack.pop()
            close = np.bitwise_count(unseen ^ y) <= distance
            if close.any():
                got, unseen = unseen[close], unseen[~close]
                got = got[got != x]
                a.append(np.full(len(got), y))
                b.append(got)
                stack.extend(got)
                reached.update(got.tolist())
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


#: Pairs of a group up to which all are compared at once.
DENSE = 4096


def links(fps: DataFrame, parts: int, distance: int = DISTANCE, hot: int = 20_000, gathered: int = 100_000) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are within the distance, not every such pair.

    An anchor that is home to more than ``hot`` fingerprints is cut into a grid by the hashes of homes and copies, so that
    no task has more than about ``hot`` of its homes, nor the copies of more than ``hot`` homes from each anchor nearby.
    In a task the homes of an anchor come first and are held, its copies pass by in batches.
    """
    ship(fps.sparkSession)

    def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, anchor in enumerate(homes(fp, parts)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], ["part", "anchor", "fp"])

    def copy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(whole), 4096):
                fp = whole[lo : lo + 4096]
                for k, i, anchor in copies(fp, parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(anchor.view(np.int64)), pa.array(fp[i].view(np.int64))], ["part", "anchor", "fp"])

    schema = "part int, anchor bigint, fp bigint"
    home = fps.mapInArrow(home_rows, schema)
    copy = fps.mapInArrow(copy_rows, schema)
    # Few anchors are this full, at most one for each `hot` fingerprints of a part.
    full = home.groupBy("part", "anchor").count().where(F.col("count") > hot).select("part", "anchor", F.ceil(F.col("count") / hot).cast("int").alias("splits"))
    home, copy = (x.join(full, ["part", "anchor"], "left").withColumn("splits", F.coalesce("splits", F.lit(1))) for x in (home, copy))
    share = lambda seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col("splits")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    home = home.select("part", "anchor", "splits", share(0).alias("row"), each.alias("column"), "fp", F.lit(True).alias("home"))
    copy = copy.select("part", "anchor", "splits", each.alias("row"), share(1).alias("column"), "fp", F.lit(False).alias("home"))
    group = ["part", "anchor", "row", "column"]
    met = home.unionByName(copy).withColumn("row", F.when(F.col("splits") > 1, F.col("row")).otherwise(-1)).drop("splits").repartition(*group).sortWithinPartitions(*group, F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, homes_ = None, np.zeros(0, np.uint64)
        for batch in _gathered(batches, gathered):
            key, fp, home = _columns(batch)
            if last is not None and np.array_equal(key[0], last):
                key = np.concatenate([np.broadcast_to(last, (len(homes_), key.shape[1])), key])
                fp, home = np.concatenate([homes_, fp]), np.concatenate([np.ones(len(homes_), dtype=bool), home])
            yield _compare(key, fp, home, distance)
            last = key[-1]
            homes_ = fp[home & (key == last).all(axis=1)]

    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if any(x.num_rows for x in held):
        yield pa.concat_batches(held)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, fingerprint and whether it is a home of each row."""
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "anchor", "row", "column")], axis=1)
    return key, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links between the homes and the copies of each group; rows of a group stand together.

    Of crowded groups and of cells of a grid (row 0 and up) a spanning forest of them.
    """
    new = np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)])
    group = np.cumsum(new) - 1
    h, c = np.flatnonzero(home), np.flatnonzero(~home)
    nc = np.bincount(group[c], minlength=group[-1] + 1)
    nh = np.bincount(group[h], minlength=group[-1] + 1)
    dense = (nc * nh > DENSE) | (key[new, 2] >= 0)
    a, b = [], []
    for g in np.flatnonzero(dense):
        x, y = _links(fp[h[group[h] == g]], fp[c[group[c] == g]], distance)
        a.append(x)
        b.append(y)
    h = h[~dense[group[h]]]
    at = np.cumsum(nc) - nc
    for lo in range(0, len(h), 20_000):
        own = h[lo : lo + 20_000]
        n = nc[group[own]]
        x = np.repeat(own, n)
        y = c[np.repeat(at[group[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        close = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) & (fp[x] != fp[y])
        a.append(fp[x[close]])
        b.append(fp[y[close]])
    a = np.concatenate(a) if a else np.zeros(0, np.uint64)
    b = np.concatenate(b) if b else np.zeros(0, np.uint64)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["a", "b"])


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text", parts: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked over chains of fingerprints at most ``distance`` bits apart.

    component_id is the smallest doc_id reachable; equal fingerprints are linked. A null or empty text has fingerprint
    zero and is linked like any other; repeated rows come out as often as they came in; a null doc_id is no id.

    ``parts`` is 3 or 2: halves of the bits have more anchors, with fewer fingerprints each but 340 copies of every
    fingerprint in place of 45. The links are the same.
    """
    if parts not in (2, 3):
        raise ValueError(f"the covering is for 2 or 3 parts, not {parts}")
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the covering is for distances up to {DISTANCE}")
    own = stored(fingerprints(docs, shingle, text))
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(classes.select("fp"), parts, distance)
    root = components(found.select("a", "b"))
    label = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    named = label.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, distance: int = DISTANCE, text: str = "text") -> DataFrame:
    """One row, with all its columns, of each near-duplicate component: that of the smallest doc_id.

    Of rows that repeat this doc_id one stays. A row without doc_id cannot be told from its copies and stays.
    """
    found = near_duplicates(docs, distance, text)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def similar(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents over chains of links of sets of word shingles alike to ``percent`` hundredths.

    Documents whose fingerprints are linked are proposed as alike to the first of them and counted exactly; sets that are
    alike, but not by their fingerprints, are found by the Jaccard join. A text without words, or null, has no shingles and
    is linked with nothing. Repeated rows and null ids are as in ``jaccard_components``.
    """
    found = near_duplicates(docs, text=text, shingle=shingle).where("doc_id <> component_id")
    proposals = stored(found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))
    return jaccard_components(docs, shingle, percent, text, proposals)


def unlike(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row, with all its columns, of each component of ``similar``: that of the smallest doc_id.

    Texts without words are copies of each other, so that of the smallest doc_id stays. Of rows that repeat a kept doc_id one
    stays. A row without doc_id cannot be told from its copies and stays.
    """
    found = stored(similar(docs, shingle, percent, text).where("doc_id is not null"))
    first = found.where("n_shingles > 0 and doc_id = component_id").select("doc_id")
    blank = found.where("n_shingles = 0").agg(F.min("doc_id").alias("doc_id"))
    named = docs.join(first.unionByName(blank).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
