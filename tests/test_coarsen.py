"""Coarsening: what the coarse hypergraph says of a partition holds for the whole one."""

import random

from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.operators import coarsen, metrics


def test_coarse_partition_has_the_same_cut(spark):
    rng = random.Random(8)
    rows = [(n, v) for n in range(80) for v in rng.sample(range(40), rng.randrange(1, 5))]
    hg = Hypergraph.of(spark.createDataFrame(rows, "net long, v long"), vertices=spark.range(42).toDF("v"))
    groups = hg.vertices.where("v < 40").select("v", (1000 + F.col("v") % 6).alias("coarse"))
    found = coarsen.contract(hg, groups)
    weights = {r.v: r.weight for r in found.weights.collect()}
    assert sum(weights.values()) == 42 and weights[40] == weights[41] == 1
    sets = {}
    for n, v in rows:
        sets.setdefault(n, set()).add(1000 + v % 6)
    sets = {n: frozenset(s) for n, s in sets.items() if len(s) > 1}
    lowest = {s: min(n for n in sets if sets[n] == s) for s in sets.values()}
    assert dict(map(tuple, found.merged.collect())) == {n: lowest[s] for n, s in sets.items()}
    parts = found.hg.vertices.select("v", (F.col("v") % 3).cast("int").alias("part"))
    all_groups = groups.unionByName(spark.createDataFrame([(40, 40), (41, 41)], "v long, coarse long"))
    fine = metrics.report(hg, coarsen.projected(all_groups, parts)).first()
    assert tuple(coarsen.weighted_cut(found.hg, parts).first()) == (fine.cn, fine.tv)


def test_nets_that_only_look_equal_stay(spark, monkeypatch):
    """With fingerprints that all collide nets are still told apart."""
    pins = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7), (3, 5), (3, 6), (4, 6), (4, 7)], "net long, v long")
    monkeypatch.setattr(coarsen.F, "xxhash64", lambda *_: F.lit(0))
    assert sorted(map(tuple, coarsen.equal_nets(pins).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_empty(spark):
    none = Hypergraph.of(spark.createDataFrame([], "net long, v long"))
    found = coarsen.contract(none, spark.createDataFrame([], "v long, coarse long"))
    assert found.hg.pins.count() == found.merged.count() == 0 and tuple(coarsen.weighted_cut(found.hg, spark.createDataFrame([], "v long, part int")).first()) == (0, 0)
