"""Coloured sweeps: what each colour is said to gain is the real change of both objectives."""

import random

import pytest
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.operators import metrics, refine
from pinweave.store import settle


def hypergraph(spark, seed, vertices, nets, hub=0):
    rng = random.Random(seed)
    rows = [(n, v) for n in range(nets) for v in rng.sample(range(vertices), rng.randrange(2, 5))]
    rows += [(nets, v) for v in range(hub)]
    hg = Hypergraph.of(spark.createDataFrame(rows, "net long, v long"), vertices=spark.range(vertices).toDF("v"))
    parts = settle(spark.createDataFrame([(v, rng.choice((0, 0, 0, 1, 2))) for v in range(vertices)], "v long, part int"))
    return Hypergraph(settle(hg.pins), settle(hg.vertices), settle(hg.nets)), parts


def test_gains_of_each_colour_are_exact(spark):
    hg, parts = hypergraph(spark, 5, 60, 70, hub=50)
    moves = settle(refine.one_each(refine.tv_moves(refine.Frozen(hg, parts, 3), guard=False)))
    colours = {r.v: r.colour for r in refine.colour_moves(hg, parts, moves).collect()}
    met = {}
    for r in refine.conflicts(hg, parts, moves).collect():
        met.setdefault(r.net, []).append(r.v)
    assert all(len({colours[v] for v in own}) == len(own) for own in met.values()) and len(set(colours.values())) > 1
    # The hub net keeps pins in its parts, so most vertices on it do not meet there.
    assert set(colours) == {r.v for r in moves.collect()}
    state = refine.State(hg, parts, 3, settle(refine.colour_moves(hg, parts, moves)).withColumnRenamed("colour", "b"))
    before = metrics.report(hg, parts).first()
    for colour in sorted(set(colours.values())):
        at = refine.Batch(state, colour)
        own = settle(refine.exact_changes(at, moves.join(at.parts.select("v"), "v", "left_semi")))
        gain = own.agg(F.sum("tv_gain"), F.sum("cn_gain")).first()
        state.apply(at, own)
        now = metrics.report(hg, refine.applied(parts, state.moved.table().withColumnRenamed("part", "to_part"))).first()
        assert (before.tv - now.tv, before.cn - now.cn) == tuple(gain)
        before = now
    # What the state carries along is what a new count gives.
    after = refine.applied(parts, state.moved.table().withColumnRenamed("part", "to_part"))
    fresh = refine.Frozen(hg, after, 3)
    assert sorted(map(tuple, state.messages.table().collect())) == sorted(map(tuple, fresh.messages.collect()))
    assert [(r.part, r.size) for r in fresh.sizes.orderBy("part").collect()] == list(enumerate(state.part_size))
    assert [(r.part, r.load) for r in fresh.loads("msv").orderBy("part").collect()] == list(enumerate(state.send))


@pytest.mark.parametrize("objective", ["tv", "cn"])
def test_a_coloured_sweep_never_worsens(spark, objective):
    hg, parts = hypergraph(spark, 6, 50, 45)
    before = metrics.report(hg, parts).first()
    after, gained = refine.sweep_coloured(hg, parts, 3, objective)
    now = metrics.report(hg, after).first()
    assert before.tv - now.tv == sum(g["tv_gain"] for g in gained) and before.cn - now.cn == sum(g["cn_gain"] for g in gained)
    assert now[objective] <= before[objective]


def test_other_objectives_are_errors(spark):
    hg, parts = hypergraph(spark, 6, 10, 5)
    with pytest.raises(ValueError):
        refine.refine(hg, parts, 3, "tm", mode="colour")
