"""Placement by messages in batches and streams, queue order, components: against plain versions."""

import random
from collections import deque

import pytest

from pinweave.model import Hypergraph
from pinweave.operators import components, graph, place
from pinweave.store import settle
from pinweave.streaming import placement


def random_nets(seed, vertices, nets, most):
    rng = random.Random(seed)
    return [sorted(rng.sample(range(vertices), rng.randrange(1, most + 1))) for _ in range(nets)]


def build(spark, nets, vertices=None):
    pins = spark.createDataFrame([(n, v) for n, own in enumerate(nets) for v in own], "net long, v long")
    return Hypergraph.of(pins, vertices=spark.range(vertices).toDF("v") if vertices else None)


def shuffled(spark, vertices, seed=1):
    order = list(range(vertices))
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(v, k) for k, v in enumerate(order)], "v long, ord long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_message_batches_of_one_are_the_exact_placement(spark):
    hg, order = build(spark, random_nets(2, 9, 14, 4), 9), shuffled(spark, 9)
    exact = rows(place.place(hg, order, 3, "tm"))
    assert rows(place.place_batches(hg, order, 3, "tm", batch=1)) == exact
    assert len({p for _, p in exact}) == 3


def test_message_stream_goes_on_after_a_restart(spark, tmp_path):
    hg, order = build(spark, random_nets(3, 24, 40, 5), 24), shuffled(spark, 24)
    expected = rows(place.place_batches(hg, order, 4, "tm", batch=8))
    stream = settle(place.stream_rows(hg, order))
    state = f"file://{tmp_path}/state"
    for epoch in range(3):  # each batch by a placer made anew
        placer = placement.StreamPlacer(spark, 24, 4, "tm", state)
        own = stream.where(f"ord between {8 * epoch} and {8 * epoch + 7}")
        placer(own, epoch)
        placer(own, epoch)
    again = placement.StreamPlacer(spark, 24, 4, "tm", state)
    assert rows(again.parts()) == expected and again.connected.any()
    for k, policy in ((4, "tv"), (5, "tm")):
        with pytest.raises(ValueError):
            placement.StreamPlacer(spark, 24, k, policy, state)


def test_unknown_policies_are_errors(spark):
    hg, order = build(spark, [[0, 1], [1, 2]]), shuffled(spark, 3)
    for bad in (lambda: place.place_batches(hg, order, 2, "msm"), lambda: placement.StreamPlacer(spark, 3, 2, "nonsense"), lambda: place.place_batch(order, order, [0, 0], 1.0, "x")):
        with pytest.raises(ValueError):
            bad()


def test_more_parts_than_vertices_by_messages(spark):
    hg, order = build(spark, [[0, 1], [1, 2]]), shuffled(spark, 3)
    assert sorted(p for _, p in rows(place.place_batches(hg, order, 5, "tm", batch=2))) == [0, 1, 2]


def queue_order(nets, vertices, start):
    of = {v: [n for n, own in enumerate(nets) if v in own] for v in range(vertices)}
    seen, order, queue = {start}, [start], deque([start])
    while queue:
        for n in of[queue.popleft()]:
            for v in nets[n]:
                if v not in seen:
                    seen.add(v)
                    order.append(v)
                    queue.append(v)
    return order + [v for v in range(vertices) if v not in seen]


@pytest.mark.parametrize("seed,vertices,nets,most,start", [(1, 40, 22, 4, 0), (2, 30, 40, 3, 17), (3, 12, 3, 2, 5)])
def test_queue_order(spark, seed, vertices, nets, most, start):
    nets = random_nets(seed, vertices, nets, most)
    got = graph.bfs_queue_order(build(spark, nets, vertices), start).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(vertices)) and [r.v for r in got] == queue_order(nets, vertices, start)


def test_queue_order_of_nothing(spark):
    assert graph.bfs_queue_order(build(spark, [[0]]).__class__.of(spark.createDataFrame([], "net long, v long"))).count() == 0


def test_components_of_huge_ids_and_hubs(spark):
    top = 2**63 - 1
    star = [(0, v) for v in range(3000)]
    chain = [(k, top - k) for k in range(1, 9)] + [(k, top - k - 1) for k in range(1, 9)]
    pins = spark.createDataFrame(star + chain + [(50, -7), (50, -(2**63)), (51, 2**62)], "net long, v long")
    got = dict(rows(components.connected_components(Hypergraph.of(pins, vertices=spark.createDataFrame([(v,) for v in {v for _, v in star + chain} | {-7, -(2**63), 2**62, 77777}], "v long")))))
    assert {got[v] for v in range(3000)} == {0}
    assert {got[top - k] for k in range(1, 10)} == {top - 9}
    assert got[-7] == got[-(2**63)] == -(2**63) and got[2**62] == 2**62 and got[77777] == 77777


def test_components_against_a_plain_search(spark):
    nets = random_nets(7, 80, 45, 3)
    up = list(range(80))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for own in nets:
        for v in own:
            a, b = sorted((find(own[0]), find(v)))
            up[b] = a
    hg = build(spark, nets, 80)
    assert rows(components.connected_components(hg)) == [(v, find(v)) for v in range(80)]
    sizes = [sum(find(w) == v for w in range(80)) for v in range(80)]
    best = max(range(80), key=lambda v: (sizes[v], -v))
    largest = components.largest_component(hg)
    assert rows(largest.vertices) == [(v,) for v in range(80) if find(v) == best]
    assert rows(largest.pins) == sorted((n, v) for n, own in enumerate(nets) for v in own if find(v) == best)
