"""Repetition rules from a word suffix array: maximal repeated substrings, their union, and limits on both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns
from pinweave.llm.words import BLANK, hashes, mix, per_document, slices, spans

WINDOW = 5
MIN_WORDS = 10
#: Percent of a text's words that repeats may cover, and words that one repeat may have.
MAX_COVERED, MAX_LONGEST = 20, 50


class Level:
    """Ranks of suffixes by their first ``size`` words; only of those that some other suffix shares the words with."""

    def __init__(self, size: int, rank: np.ndarray, open_: np.ndarray):
        self.size, kind = size, np.int32 if len(rank) < 1 << 31 else np.int64
        self.at = None if 2 * len(open_) > len(rank) else np.sort(open_).astype(kind)
        self.rank = (rank if self.at is None else rank[self.at]).astype(kind)

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two different suffixes agree in so many words."""
        if self.at is None:
            return self.rank[x] == self.rank[y]
        if not len(self.at):
            return np.zeros(len(x), dtype=bool)
        i, j = (np.minimum(np.searchsorted(self.at, z), len(self.at) - 1) for z in (x, y))
        return (self.at[i] == x) & (self.at[j] == y) & (self.rank[i] == self.rank[j])


def suffix_array(keys: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """Suffix array of words by prefix doubling, and the ranks by the first 1, 2, 4, ... words.

    ``keys`` are equal where words of one document are equal and never for words of two; ``end`` is where each word's
    document ends. Only suffixes that are not told apart yet are sorted again, and only their ranks are kept.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    group = keys[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.concatenate([new[1:], [True]])
    open_ = order[~alone]
    levels = [Level(1, rank, open_)]
    k = 1
    while len(open_):
        after = open_ + k
        inside = after < end[open_]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[open_]
        key = first * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        open_, key, first = open_[sort], key[sort], first[sort]
        size = len(open_)
        at = np.arange(size)
        base = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - base
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
        levels.append(Level(k, rank, open_))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def longest_repeats(keys: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run of words from it that its document holds elsewhere, too.

    It is the larger of the two longest common prefixes with the neighbours in the suffix array.
    """
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    suffixes, levels = suffix_array(keys, end)
    same = keys[suffixes[1:]] == keys[suffixes[:-1]]
    t = np.flatnonzero(same)
    a, b = suffixes[t], suffixes[t + 1]
    lcp = np.zeros(len(t), np.int64)
    for level in reversed(levels):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        lcp += np.where(ok & level.same(x, y), level.size, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def maximal_repeats(longest: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of repeats of ``least`` words or more that no word before them extends."""
    n = len(longest)
    before = np.zeros(n, np.int64)
    before[1:] = longest[:-1]
    before[first[first < n]] = 0
    start = np.flatnonzero((longest >= least) & (before <= longest))
    return start, longest[start]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta)[:n] > 0


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_LINE = np.zeros(256, dtype=bool)
_LINE[0x0A] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(total[offsets])


def measure(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Counts for each document of a buffer."""
    docs = len(offsets) - 1
    starts, ends = spans(buf, offsets, BLANK)
    first = per_document(starts, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(docs), n_words)
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64))
    keys = mix(hashes(buf, starts, ends) ^ salt[doc])
    longest = longest_repeats(keys, first[1:][doc])
    at, size = maximal_repeats(longest, first[:-1], window)
    repeat = covered(len(starts), at, size)
    line_starts, line_ends = spans(buf, offsets, _LINE)
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[wordy], line_ends[wordy]
    of = np.searchsorted(offsets, line_starts, side="right") - 1
    _, distinct = np.unique(mix(hashes(buf, line_starts, line_ends) ^ salt[of]), return_index=True)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_words": n_words,
        "word_chars": _sums(~BLANK[buf] & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[buf], offsets),
        "n_dup_lines": np.bincount(of, minlength=docs) - np.bincount(of[distinct], minlength=docs),
        "n_repeat_words": _sums(repeat, first),
        "longest_repeat": most,
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def repetition(docs: DataFrame, window: int = WINDOW, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """doc_id, the counts of each text, base_failed and kept.

    Words are runs of non-blanks. A text fails the base rule with under ``min_words`` words or if repeats of ``window``
    words or more cover over ``max_covered`` percent of its words; it is kept if it passes and its longest repeat has at
    most ``max_longest`` words. A null or empty text has no words and fails. Repeated rows are judged one by one, a null
    doc_id stays null, columns other than doc_id and the text are left out.
    """
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for s in slices(batch.column(text)):
                found = measure(s.buf, s.offsets, window)
                yield pa.RecordBatch.from_arrays([ids.slice(s.lo, s.hi - s.lo), *map(pa.array, found.values())], ["doc_id", *found])

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_covered * F.col("n_words"))
    counted = docs.mapInArrow(run, f"doc_id bigint, {COUNTS}").withColumn("base_failed", failed)
    return counted.withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= max_longest))


#: Repeats of L words or more exist where a window of L words occurs twice.
SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM w),
g AS (SELECT doc_id, i, hash(list_slice(words, i, i + {WINDOW} - 1)) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
lp AS (SELECT doc_id, words, unnest(range(1, len(words) - {MAX_LONGEST} + 1)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM r)),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, hash(list_slice(words, i, i + {MAX_LONGEST})) AS h FROM lp GROUP BY 1, 2 HAVING count(*) > 1)),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS wordy, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, l.doc_id IS NOT NULL AS long
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, (len(wordy) - len(list_distinct(wordy)))::BIGINT AS n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_COVERED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_COVERED} * n_words) AND NOT long AS kept
FROM m
"""
