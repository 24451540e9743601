"""Jaccard join of documents' word n-gram sets by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, once finely to find candidates and once
coarsely to count.

*Candidates.* Two linked sets of sizes a and b differ in at most D = (a + b) (100 - p) / (100 + p) n-grams. Among F
fragments, more than D, at least F - D are then equal in both. Fragments are ranked, those of most n-grams first. Equal ones
stand in the same order in both sets, and no more than D others come before the first of them; so each set offers as many as
its own largest partner asks for, and linked sets share one. F is that of a level of sizes; a set that may be linked with
larger ones of the next level takes part there, too.

*Counting.* For a pair of sets the common n-grams are counted in each coarse fragment separately and summed up. Pairs whose
parities of n-grams in 512 cells, which differ in no more cells than the sets in n-grams, rule a link out are not counted.

*Groups of near copies.* Equal sets are one class. Each set is first compared with what was proposed for it, or else with one other, that
with which it shares most fragments among the first ones of its groups; then all of a group that shares a fragment with its first one, then
with its last one; a group whose members are all in one component asks for nothing more. In what is left members of
different components are paired, in blocks. So no link between components is lost.

Offers and n-grams are made anew from the texts where they are needed, so that only their own shuffles hold them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinweave.functions.expressions import renumbered
from pinweave.llm.components import components
from pinweave.llm.shared import kept_columns, stored
from pinweave.llm.words import BLANK, LOWER, hashes, mix, per_document, slices, spans

SHINGLE, PERCENT = 5, 80
#: N-grams of a coarse fragment at most about twice this, cells of parities, members of a block.
COARSE_BITS, CELLS, BLOCK = 11, 512, 500
#: Keys with over one in so many of all rows are broadcast in place of shuffled to one task.
HEAVY = 1000
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


@lru_cache(maxsize=8)
def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each level, and the n-grams in which linked sets of a level may differ.

    Smaller sets than the first level's are linked with equal ones only.
    """
    apart, together = 100 - percent, 100 + percent
    lo = [-(-(together - apart) // (2 * apart)) or 1]
    while lo[-1] < 1 << 40:
        lo.append(max(lo[-1] + 1, 2 * lo[-1], -(-lo[-1] * 100 // percent)))
    return np.array(lo), np.array([2 * (hi - 1) * apart // together for hi in lo[1:]])


def fragments(differ: np.ndarray) -> np.ndarray:
    """Fine fragments of a level: a seventh more than are needed, so that the emptiest need not be offered."""
    return differ + 1 + -(-(differ + 1) // 7)


def differences(size: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """N-grams in which a set of this size may differ from any of a level that it may be linked with."""
    largest = np.minimum(size * 100 // percent, levels(percent)[0][level + 1] - 1)
    return (size + largest) * (100 - percent) // (100 + percent)


def ngrams(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the documents in a buffer, by document and hash, and where each document's begin."""
    starts, ends = spans(buf, offsets, BLANK)
    first = per_document(starts, offsets)
    words = np.diff(first)
    word = hashes(buf, starts, ends)
    take = np.minimum(words, shingle)
    number = np.where(words > 0, words - take + 1, 0)
    doc = np.repeat(np.arange(len(words)), number)
    at = np.arange(len(doc)) + (first[:-1] - (np.cumsum(number) - number))[doc]
    h = mix(take[doc].astype(np.uint64) + _SALT[0])
    for k in range(shingle):
        inside = k < take[doc]
        h = np.where(inside, mix(h ^ word[np.minimum(at + k, max(len(word) - 1, 0))]), h) if len(word) else h
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """16 bytes for each set, equal for equal sets."""
    size = np.diff(at)
    out = np.zeros((len(size), 2), ">u8")
    has = np.flatnonzero(size)
    for k in range(2):
        if len(has):
            out[has, k] = mix(np.add.reduceat(mix(h ^ _SALT[k]), at[has]) ^ size[has].astype(np.uint64))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.arange(0, 16 * len(size) + 1, 16, dtype=np.int32)), pa.py_buffer(out.tobytes())])


def offered(h: np.ndarray, at: np.ndarray, percent: int) -> list[np.ndarray]:
    """The fragment keys that each set offers."""
    size = np.diff(at)
    lo, differ = levels(percent)
    own = np.searchsorted(lo, size, side="right") - 1
    out: list[list[np.ndarray]] = [[] for _ in size]
    for level, sets in ((own, own >= 0), (own + 1, (own >= 0) & (100 * size >= percent * lo[np.maximum(own, 0) + 1]))):
        which = np.flatnonzero(sets)
        if not len(which):
            continue
        run = np.repeat(which, size[which])
        own_h = h[np.repeat(at[which] - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(len(run))]
        most = differences(size, np.maximum(level, 0), percent)
        pieces = fragments(differ[np.maximum(level, 0)])
        f = ((own_h >> np.uint64(32)) * pieces[run].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (f[1:] != f[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(run)))
        doc, f = run[begin], f[begin]
        place = mix((level[doc].astype(np.uint64) << np.uint64(48)) ^ f ^ _SALT[2])
        key = mix(mix(np.add.reduceat(mix(own_h ^ _SALT[3]), begin) ^ count.astype(np.uint64)) ^ place)
        order = np.lexsort((key, -count, doc))
        doc, key, f = doc[order], key[order], f[order]
        start = np.searchsorted(doc, which)
        rank = np.arange(len(doc)) - start[np.searchsorted(which, doc)]
        taken = rank <= most[doc]
        bounds = np.append(start, len(doc))
        for k, d in enumerate(which.tolist()):
            a, b = bounds[k], bounds[k + 1]
            out[d].append(key[a:b][taken[a:b]])
            missing = int(most[d]) + 1 - int(b - a)
            if missing > 0:  # fragments without n-grams come last
                empty = np.setdiff1d(np.arange(pieces[d], dtype=np.uint64), f[a:b])
                out[d].append(np.sort(mix(mix(np.uint64(level[d]) << np.uint64(48) ^ _SALT[1]) ^ empty))[:missing])
    none = np.zeros(0, np.uint64)
    return [np.concatenate(x) if x else none for x in out]


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set a row of 64-bit words: which of CELLS cells hold an odd number of its n-grams."""
    size = np.diff(at)
    out = np.zeros((len(size), CELLS // 64), np.uint64)
    for lo in range(0, len(size), 4096):
        hi = min(lo + 4096, len(size))
        cell = (mix(h[at[lo] : at[hi]] ^ _SALT[1]) & np.uint64(CELLS - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(hi - lo), size[lo:hi]) * CELLS + cell, minlength=(hi - lo) * CELLS) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8).reshape(hi - lo, CELLS), axis=1).view(np.uint64)
    return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    own = kept_columns(docs, {"doc_id": "bigint", text: "string"}).select("doc_id", F.col(f"`{text}`").alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text"))


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n, node) of each document; n is the size of its set, node the set's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                h, at = ngrams(LOWER[s.buf], s.offsets, shingle)
                kept = [batch.column(c).slice(s.lo, s.hi - s.lo) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at)), set_ids(h, at)], ["doc_id", "text_hash", "n", "node"])

    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, node binary")


def _of_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted``, which name a document of each set by doc_id and text_hash, with that document's text.

    A document that is there several times gives its set several times.
    """
    named = wanted.withColumnsRenamed({"doc_id": "wanted_id", "text_hash": "wanted_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    return texts.join(named, same).select("text", *[c for c in wanted.columns if c not in ("doc_id", "text_hash")])


def _slices_of_sets(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``_of_sets`` with their n-grams, other texts of the same hash left out."""
    for batch in batches:
        for s in slices(batch.column("text")):
            h, at = ngrams(LOWER[s.buf], s.offsets, shingle)
            own = batch.slice(s.lo, s.hi - s.lo)
            right = pc.equal(set_ids(h, at), own.column("node")).to_numpy(zero_copy_only=False)
            if not right.all():
                h = h[np.repeat(right, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(np.diff(at)[right])])
                own = own.filter(pa.array(right))
            yield own, h, at


def offers(texts: DataFrame, numbered: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, id, n): the fragments that each of the numbered sets offers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, h, at in _slices_of_sets(batches, shingle):
            keys = offered(h, at, percent)
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), own.column("id").take(row), own.column("n").take(row)], ["key", "id", "n"])

    return _of_sets(texts, numbered.select("doc_id", "text_hash", "id", "n", "node")).mapInArrow(run, "key bigint, id bigint, n bigint")


def set_parities(texts: DataFrame, numbered: DataFrame, shingle: int) -> DataFrame:
    """(id, bits) of the numbered sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, h, at in _slices_of_sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([own.column("id"), _lists(list(parities(h, at)))], ["id", "bits"])

    return _of_sets(texts, numbered.select("doc_id", "text_hash", "id", "node")).mapInArrow(run, "id bigint, bits array<bigint>").dropDuplicates(["id"])


def _coarse(n: Column) -> Column:
    """Coarse fragments of a set of n n-grams, a power of two."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(n)) - COARSE_BITS, F.lit(0))).cast("int")


def sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(hub, id, pieces, f, grams): the n-grams of each row of ``wanted`` in so many coarse fragments, empty ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, h, at in _slices_of_sets(batches, shingle):
            pieces = own.column("pieces").to_numpy().astype(np.uint64)
            doc = np.repeat(np.arange(len(pieces)), np.diff(at))
            f = (((h >> np.uint64(32)) * pieces[doc]) >> np.uint64(32)).astype(np.int64)
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
            begin = np.flatnonzero(new)
            grams = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()), pa.array(h.view(np.int64)))
            row = pa.array(doc[begin])
            yield pa.RecordBatch.from_arrays([*(own.column(c).take(row) for c in ("hub", "id", "pieces")), pa.array(f[begin], pa.int32()), grams], ["hub", "id", "pieces", "f", "grams"])

    return _of_sets(texts, wanted.select("doc_id", "text_hash", "hub", "id", "pieces", "node")).mapInArrow(run, "hub bigint, id bigint, pieces int, f int, grams array<bigint>")


def _dealt(rows: DataFrame, table: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """rows joined with a table of one row, with its number of rows ``n_rows``, for each key, in one shuffle of each.

    Rows of a heavy key are dealt by another column to several tasks, which all get the key's row. ``salt`` says to which.
    """
    share = max(total // HEAVY, HEAVY)
    copies = F.ceil(F.col("n_rows") / share).cast("int")
    heavy = F.broadcast(table.where(F.col("n_rows") > share).select(key, copies.alias("copies")))
    salted = rows.join(heavy, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))), [key, "salt"])


def _with(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with a table of one row, with its number of rows ``n_rows``, for each key; heavy keys are broadcast."""
    heavy = F.broadcast(table.where(F.col("n_rows") > max(total // HEAVY, HEAVY)))
    light = table.where(F.col("n_rows") <= max(total // HEAVY, HEAVY))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _near(percent: int) -> Column:
    """Whether parities allow a link."""
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("hub_bits")[k])) for k in range(CELLS // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("hub_n") + F.col("n"))


def close(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of pairs (hub, id, hub_n, n) those whose parities allow a link."""
    pairs = stored(pairs.distinct())
    hubs = stored(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n_rows")).join(bits.toDF("hub", "hub_bits"), "hub"))
    return _dealt(pairs.join(bits, "id"), hubs, "hub", "id", pairs.count()).where(_near(percent)).select(pairs.columns)


def linked(pairs: DataFrame, texts: DataFrame, names: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (hub, id, hub_n, n) those that are linked, by counts of their fragments.

    A hub with very many pairs has its fragments copied, so that its pairs are dealt to several tasks.
    """
    pairs = stored(pairs.distinct().withColumn("pieces", _coarse(F.greatest("hub_n", "n"))))
    share = max(pairs.count() // HEAVY, HEAVY)
    hubs = stored(pairs.groupBy("hub", "pieces").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies")))
    many = F.broadcast(hubs.where("copies > 1"))
    document = names.select("id", "node", "doc_id", "text_hash")
    asked = sets(texts, pairs.select("hub", "id", "pieces").join(document, "id"), shingle)
    asked = asked.join(many, ["hub", "pieces"], "left").withColumn("copy", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int"))
    own = sets(texts, hubs.select("hub", "pieces", F.col("hub").alias("id")).join(document, "id"), shingle).select("hub", "pieces", "f", F.col("grams").alias("hub_grams"))
    own = own.join(many, ["hub", "pieces"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    met = asked.drop("copies").join(own.drop("copies"), ["hub", "pieces", "f", "copy"])
    # A document that is there several times gives the same number several times.
    each = met.groupBy("hub", "pieces", "f", "copy", "id").agg(F.max(F.size(F.array_intersect("hub_grams", "grams"))).alias("both"))
    counted = each.groupBy("hub", "id").agg(F.sum("both").alias("both")).join(pairs, ["hub", "id"])
    return counted.where(100 * F.col("both") >= percent * (F.col("hub_n") + F.col("n") - F.col("both"))).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _alike(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, n, label) of the keys whose ids are in several components."""
    own = stored(rows.select("key", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("label")))
    several = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "n_rows")
    return stored(_with(own, several, "key", own.count()))


def _with_hub(rows: DataFrame, lowest: bool, percent: int) -> DataFrame:
    """Pairs of each row with one id of its key, the lowest or highest, of another component."""
    pick = F.min("id") if lowest else F.max("id")
    hub = rows.groupBy("key").agg(pick.alias("hub"), F.count(F.lit(1)).alias("n_rows"))
    named = stored(hub.join(rows.select(F.col("key"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label")), ["key", "hub"]))
    met = _with(rows.select("key", "id", "n", "label"), named, "key", rows.count())
    return met.where((F.col("label") != F.col("hub_label")) & _alike("hub_n", "n", percent)).select("hub", "id", "hub_n", "n")


def _across(rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids of one key and different components whose parities allow a link.

    One of the two is not of the key's largest component: these meet all members, block by block.
    """
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("n_label", "label")).alias("largest"), F.sum("n_label").alias("n_rows"))
    blocks = F.ceil(F.col("n_rows") / BLOCK).cast("int")
    full = stored(_with(rows.select("key", "id", "n", "label"), largest.withColumn("blocks", blocks), "key", rows.count()).join(bits, "id"))
    every = full.select("key", F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"), F.col("bits").alias("hub_bits"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    few = full.where("label <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "id", "n", "label", "bits", "block")
    return every.join(few, ["key", "block"]).where((F.col("label") != F.col("hub_label")) & _alike("hub_n", "n", percent) & _near(percent)).select("hub", "id", "hub_n", "n")


def _most_shared(pairs: DataFrame) -> DataFrame:
    """Of pairs (hub, id, hub_n, n), one for each fragment shared, that of each id with the hub it shares most with."""
    counted = pairs.groupBy("hub", "id", "hub_n", "n").agg(F.count(F.lit(1)).alias("m"))
    best = counted.groupBy("id").agg(F.max_by(F.struct("hub", "hub_n", "n"), F.struct("m", -F.col("hub"))).alias("best"))
    return best.select("best.hub", "id", "best.hub_n", "best.n")


def _proposed(proposals: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets for proposals (a, b) of documents; names is (doc_id, id, n), a set's document being its least one."""
    own = stored(proposals.join(names.withColumnRenamed("doc_id", "b"), "b").select("a", "id", "n"))
    hubs = own.groupBy("a").agg(F.count(F.lit(1)).alias("n_rows")).join(names.select(F.col("doc_id").alias("a"), F.col("id").alias("hub"), F.col("n").alias("hub_n")), "a")
    met = _with(own, stored(hubs), "a", own.count())
    return met.where((F.col("hub") != F.col("id")) & _alike("hub_n", "n", percent)).select("hub", "id", "hub_n", "n")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", proposals: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents over chains of links of at least ``percent`` hundredths in common.

    A document's set holds its distinct runs of ``shingle`` words (A-Z in lower case, words are runs of non-blanks), with
    fewer words the one of all its words. Without words, or null, it is empty and linked with nothing. component_id is
    the smallest doc_id reachable, itself included. Repeated rows come out as often as they came in; rows of one doc_id
    are nodes by their text, each with the component of its own; a null doc_id is no id but its text links others.
    Columns other than doc_id and the text are left out. N-grams are compared by 64-bit hashes, whole sets of equal
    documents by 128 bits.

    ``proposals`` (a, b) are pairs of documents that another method thinks alike. They are counted first, and what they link
    is not looked for again; the components are the same with and without them.
    """
    if not 50 <= percent < 100:
        raise ValueError(f"links take 50 to 99 hundredths in common, not {percent}")
    texts = _texts(docs, text)
    own = stored(described(texts, shingle))
    total = own.count()
    # The largest, as nulls come first: a document with a number where there is one.
    classes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("doc_id", "text_hash")).alias("one"))
    classes = stored(classes)
    able = classes.where(F.col("n") >= int(levels(percent)[0][0])).select("node", "n", "least", "one.doc_id", "one.text_hash")
    numbered = stored(renumbered(able, "node", "id"))
    every = offers(texts, numbered, shingle, percent)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "n_rows")
    shared = stored(shared)
    met = _dealt(every, shared, "key", "id", shared.agg(F.sum("n_rows")).first()[0] or 0).dropDuplicates(["key", "salt", "id"])
    rows = stored(met.select("key", "id", "n", F.col("id").alias("label")))
    names = stored(numbered.join(rows.select("id").distinct(), "id", "left_semi"))
    bits = stored(set_parities(texts, names, shingle))
    links = None
    if proposals is not None:
        proposed = _proposed(proposals, names.select(F.col("least").alias("doc_id"), "id", "n"), percent)
        links = stored(linked(close(proposed, bits, percent), texts, names, shingle, percent))
        roots = components(links)
        rows = _labelled(rows, roots)
    for hub in ("first", "last") if proposals is not None else ("most shared", "first", "last"):
        if links is None or not rows.isEmpty():
            pairs = _with_hub(rows, hub != "last", percent)
            pairs = _most_shared(pairs) if hub == "most shared" else pairs
            found = stored(linked(close(pairs, bits, percent), texts, names, shingle, percent))
            if links is not None and found.isEmpty():
                continue
            links = found if links is None else links.unionByName(found)
            roots = components(links)
            rows = _labelled(rows, roots)
    if not rows.isEmpty():
        roots = components(links.unionByName(stored(linked(_across(rows, bits, percent), texts, names, shingle, percent))))
    rooted = stored(names.select("id", "node", F.col("least").alias("doc_id")).join(roots.withColumnRenamed("node", "id"), "id"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    named = _with(rooted.select("root", "node"), least, "root", total).select("node", "component_id")
    label = classes.join(named, "node", "left").select("node", "n_rows", F.coalesce("component_id", "least").alias("component_id"))
    full = _with(own.where("n > 0").select("doc_id", "n", "node"), label, "node", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
