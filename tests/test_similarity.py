"""The similarity order: recall of the bands against brute force, and an order that placement takes."""

import random

import pytest

from pinweave.model import Hypergraph
from pinweave.operators import place, similarity


def pairs_alike(spark):
    """200 vertices with 40 nets each, every second one like the one before but for a few nets."""
    rng, sets = random.Random(9), []
    for v in range(200):
        if v % 2 == 0:
            own = rng.sample(range(5000), 40)
        else:
            own = [*sets[-1][3:], *rng.sample(range(5000, 9000), 3)]
        sets.append(own)
    rows = [(n, v) for v, own in enumerate(sets) for n in own]
    return Hypergraph.of(spark.createDataFrame(rows, "net long, v long"), vertices=spark.range(203).toDF("v")), [set(s) for s in sets]


def test_recall_and_order(spark):
    hg, sets = pairs_alike(spark)
    found = {}
    for r in similarity.buckets(similarity.signatures(hg, 32), 16, 2).collect():
        found.setdefault((r.band, tuple(r.key)), []).append(r.v)
    met = {(a, b) for own in found.values() for a in own for b in own if a < b}
    alike = {(a, b) for a in range(200) for b in range(a + 1, 200) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) == 100 and len(alike & met) >= 95
    order = {r.v: r.ord for r in similarity.similarity_order(hg).collect()}
    assert sorted(order.values()) == list(range(203)) and {v for v, o in order.items() if o >= 200} == {200, 201, 202}
    near = [abs(order[a] - order[b]) for a, b in alike & met]
    assert sum(n == 1 for n in near) >= 90
    parts = place.place_batches(hg, similarity.similarity_order(hg), 4, "tv", batch=70)
    assert parts.count() == 203


def test_faults_and_nothing(spark):
    none = Hypergraph.of(spark.createDataFrame([], "net long, v long"))
    assert similarity.similarity_order(none).count() == 0
    with pytest.raises(ValueError):
        similarity.similarity_order(none, 0, 2)
