"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own rate, and the L1 term keeps most weights at zero, so that what is broadcast is a short list
of (bucket, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns
from pinweave.llm.words import LOWER, NOT_ALNUM, hashes, mix, per_document, slices, spans
from pinweave.ship import ship

#: Labelled rows that training uses at most; those with the smallest hash of doc_id are taken.
SAMPLE = 12_000
BUCKET_BITS = 20


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 4
    positive: float = 2.0  # weight of a toxic row: they are the rarer
    batch_seed: int = 11


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word, word pair, and pair with one word between; words are lower-cased in A-Z."""
    buf = LOWER[buf]
    starts, ends = spans(buf, offsets, NOT_ALNUM)
    h = hashes(buf, starts, ends)
    first = per_document(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, found = [doc], [mix(h)]
    for gap, odd in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[:-gap][same])
            found.append(mix(h[:-gap] * np.uint64(odd) + (h[gap:] >> np.uint64(1)) + np.uint64(gap))[same])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Learner:
    """FTRL-proximal with per-coordinate rates; the last bucket is the intercept, which has no L1."""

    def __init__(self, p: Ftrl):
        self.p = p
        self.z, self.n = np.zeros((1 << BUCKET_BITS) + 1), np.zeros((1 << BUCKET_BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        l1 = np.where(at == 1 << BUCKET_BITS, 0.0, p.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row: its distinct buckets, each with value 1."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        g *= self.p.positive if label else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, p: Ftrl = Ftrl(), text: str = "text") -> tuple[list[int], list[float]]:
    """Non-zero weights (buckets, values), learnt from at most ``sample`` labelled rows that are not held out.

    Rows without label or doc_id are left out, as are repeated labels. Training is one bounded task; without any row the
    weights are empty and every score is a half.
    """
    own = kept_columns(labels, {"doc_id": "bigint", "toxic": "int"}).where("doc_id is not null and toxic in (0, 1)").distinct()
    own = own.where(~held_out()).withColumn("h", F.xxhash64("doc_id", F.lit(p.batch_seed))).orderBy("h", "toxic").limit(sample)
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"}).dropna(subset=["doc_id"])
    rows = docs.join(F.broadcast(own), "doc_id").select("h", "doc_id", "toxic", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        bias = np.array([1 << BUCKET_BITS])
        for batch in batches:
            label = batch.column("toxic").to_pylist()
            for s in slices(batch.column(text)):
                doc, bucket = features(s.buf, s.offsets)
                each = np.unique(doc << BUCKET_BITS | bucket)
                cut = np.searchsorted(each >> BUCKET_BITS, np.arange(s.hi - s.lo + 1))
                for k in range(s.hi - s.lo):
                    at = each[cut[k] : cut[k + 1]] & ((1 << BUCKET_BITS) - 1)
                    seen.append((np.append(at, bias).astype(np.int32), label[s.lo + k]))
        model = Learner(p)
        order = np.random.default_rng(p.batch_seed)
        for _ in range(p.epochs):
            for k in order.permutation(len(seen)):
                model.learn(*seen[k])
        w = model.weights(np.arange((1 << BUCKET_BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "weight": pa.array(w[at])})

    found = rows.repartition(1).sortWithinPartitions("h", "doc_id", "toxic", text).mapInArrow(run, "bucket bigint, weight double").collect()
    return [r[0] for r in found], [r[1] for r in found]


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def score(docs: DataFrame, weights: tuple[list[int], list[float]], text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted; a null or empty text has the intercept's score, a null doc_id is not held out."""
    docs = kept_columns(docs, {"doc_id": "bigint", text: "string"})
    sent = docs.sparkSession.sparkContext.broadcast((np.array(weights[0], np.int64), np.array(weights[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BUCKET_BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            got = [score_slice(s.buf, s.offsets, w) for s in slices(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_slice(buf: np.ndarray, offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    doc, bucket = features(buf, offsets)
    used = np.flatnonzero(w[bucket])
    each = np.unique(doc[used] << BUCKET_BITS | bucket[used])
    total = np.full(len(offsets) - 1, w[1 << BUCKET_BITS])
    np.add.at(total, each >> BUCKET_BITS, w[each & ((1 << BUCKET_BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def reject(docs: DataFrame, weights: tuple[list[int], list[float]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below a half; a null or empty text by the intercept alone."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(weights[0], np.int64), np.array(weights[1])))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BUCKET_BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            got = [score_slice(s.buf, s.offsets, w) < 0.5 for s in slices(batch.column(place))]
            if got:
                yield batch.filter(pa.array(np.concatenate(got)))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the labels that are not held out and scores every document."""
    return score(docs, train(docs, labels, sample))
