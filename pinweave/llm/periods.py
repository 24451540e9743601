"""Maximal runs of repeated word blocks by the suffix tree of each text.

At a node of depth d two of its leaves d apart are the two halves of a tandem repeat, and it branches, that is, the word
after it differs from the one that would go on, if they are leaves of two children. The leaves of all but the largest
child are looked up, each word so at most log n times, and with them every branching repeat is found. It is the last
rotation of its run: the run ends with it, and rotating it leftwards as long as words agree gives the run's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns
from pinweave.llm.suffixes import agreement, common_prefixes, suffix_array, tree
from pinweave.llm.words import BLANK, gather, hashes, mix, per_document, slices, spans

MIN_WORDS, MIN_EXPONENT = 6, 4


def branching(keys: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of every branching tandem repeat, each once, by end and period."""
    n = len(keys)
    suffixes, rank = suffix_array(keys, end)
    nodes = tree(common_prefixes(keys, suffixes))
    stops, periods = [], []
    for node, place in nodes.leaves():
        i, d, lo, hi = suffixes[place], nodes.depth[node], nodes.lo[node], nodes.hi[node]
        for first in (i, i - d):  # the leaf is the first or the second half
            second = first + d
            other = second if first is i else first
            ok = np.flatnonzero((other >= 0) & (other < n))
            ok = ok[(rank[other[ok]] >= lo[ok]) & (rank[other[ok]] < hi[ok])]
            stop, half = second[ok] + d[ok], second[ok]
            ends = stop >= end[half]
            more = ends | (keys[np.minimum(stop, n - 1)] != keys[half])
            stops.append(stop[more])
            periods.append(d[ok][more])
    stop, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (stops, periods))
    order = np.lexsort((period, stop))
    stop, period = stop[order], period[order]
    new = np.concatenate([[True], (stop[1:] != stop[:-1]) | (period[1:] != period[:-1])])[: len(stop)]
    return stop[new], period[new]


def runs(keys: np.ndarray, end: np.ndarray, min_words: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of the maximal runs, by start and period."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    stop, period = branching(keys, end)
    found = []
    while len(stop):
        new = np.concatenate([[True], stop[1:] != stop[:-1]])
        group, least = np.cumsum(new) - 1, period[new]
        start = stop[new] - 2 * least
        start = start - agreement(keys, start - 1, start - 1 + least, -1)
        length = stop[new] - start
        found.append((start, length, least))
        # A repeat of the run's own blocks, taken several at a time, is no run of its own.
        left = ~new & ~((period % least[group] == 0) & (2 * period <= length[group]))
        stop, period = stop[left], period[left]
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keep = length >= np.maximum(min_words, min_exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each text.

    ``runs`` are (start, length, period) of the maximal stretches of words with smallest period ``period``, of at least
    ``min_words`` words and ``min_exponent`` periods, in order; a word's number counts from 0 in its text. ``collapsed``
    is the text's words, joined by single blanks, without those in a run after the run's first period. A null or empty
    text has no words and runs and is collapsed to an empty text; repeated rows come out one by one, a null doc_id stays
    null, other columns are left out. Memory goes with the longest text, some 200 bytes a word.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for s in slices(batch.column(text)):
                words, offsets, found, collapsed = measure(s.buf, s.offsets, min_words, min_exponent)
                found = pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([ids.slice(s.lo, s.hi - s.lo), pa.array(words), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def measure(buf: np.ndarray, offsets: np.ndarray, min_words: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], pa.Array]:
    """Of the documents in a buffer: their words, where their runs begin, the runs, and the collapsed texts."""
    docs = len(offsets) - 1
    starts, ends = spans(buf, offsets, BLANK)
    first = per_document(starts, offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(docs), words)
    keys = mix(hashes(buf, starts, ends) ^ mix(np.arange(1, docs + 1, dtype=np.uint64))[doc])
    start, length, period = runs(keys, first[1:][doc], min_words, min_exponent)
    delta = np.zeros(len(starts) + 1, np.int64)
    np.add.at(delta, start + period, 1)
    np.add.at(delta, start + length, -1)
    kept = np.flatnonzero(np.cumsum(delta)[:-1] == 0)
    # The kept words, each with the blank after it; the last blank of a text is cut off.
    sizes = ends[kept] - starts[kept] + 1
    joined = gather(np.concatenate([buf, [np.uint8(0x20)]]).astype(np.uint8), starts[kept], sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    joined[upto[1:] - 1] = 0x20
    at = upto[np.searchsorted(kept, first)]
    last = at[1:][at[1:] > at[:-1]] - 1
    keep = np.ones(len(joined), dtype=bool)
    keep[last] = False
    size = at[1:] - at[:-1] - (at[1:] > at[:-1])
    joined = joined[keep]
    texts = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
    return words, np.searchsorted(start, first), (start - first[doc[start]] if len(start) else start, length, period), texts


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with a repeating end in every tenth text.

    With h the crc32 of the decimal doc_id and g = h // 10, texts with h % 10 = 0 have from word a = g % n on the words
    from a to a + p - 1 over and over, p = 1 + (n - a) // (3 + g % 8). Other texts and those without doc_id or words stay.
    """
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    with_words = docs.select("doc_id", text, g.alias("g"), F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), words).alias("words"))
    n = F.size("words").cast("bigint")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("bigint")
    sized = with_words.select("doc_id", text, "words", a.alias("a"), p.alias("p"))
    tail = F.expr("transform(sequence(0L, size(words) - 1L), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)])")
    return sized.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text)).alias(text))


def _longest(runs: str) -> Column:
    """The run of most periods, exactly compared; the first of equals."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(F.col(runs), F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods and checksums of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), _longest("runs").alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli, "runs_sha256", "collapsed_sha256")
