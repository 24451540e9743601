"""Coarsening: vertices of one group become one, nets that then are equal become one with their weights added up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.operators.metrics import connectivity, net_part
from pinweave.store import settle


@dataclass(frozen=True)
class Coarse:
    """The coarse hypergraph, the number of vertices in each of its vertices, and where each net has gone.

    ``merged`` is (net, into); nets within one group are not in it, as no partition of the groups can cut them.
    """

    hg: Hypergraph
    weights: DataFrame
    merged: DataFrame


def equal_nets(pins: DataFrame) -> DataFrame:
    """(net, into): the lowest net with the same pins; pins are distinct.

    Nets of one fingerprint (the number of pins and two sums of hashes) are compared pin by pin with the lowest of them; one
    that differs, which takes a collision, stays by itself.
    """
    digest = lambda seed: F.sum(F.xxhash64("v", F.lit(seed)).cast("decimal(38,0)"))
    marks = settle(pins.groupBy("net").agg(F.count(F.lit(1)).alias("n"), digest(1).alias("a"), digest(2).alias("b")))
    lowest = marks.groupBy("n", "a", "b").agg(F.min("net").alias("into"), F.count(F.lit(1)).alias("nets"))
    found = settle(marks.join(lowest.where("nets > 1"), ["n", "a", "b"]).where("net <> into").select("net", "into", "n"))
    model = pins.join(found.select(F.col("into").alias("net")).distinct(), "net", "left_semi").select(F.col("net").alias("into"), "v")
    same = pins.join(found, "net").join(model, ["into", "v"]).groupBy("net", "into", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n").select("net", "into")
    return marks.join(same, "net", "left").select("net", F.coalesce("into", "net").alias("into"))


def contract(hg: Hypergraph, groups: DataFrame) -> Coarse:
    """The hypergraph of the groups (v, coarse). A vertex without a group is one by itself under its own id.

    A net's source is its source's group; of merged nets that of the lowest one counts.
    """
    own = settle(hg.vertices.join(groups.select("v", "coarse"), "v", "left").select("v", F.coalesce("coarse", "v").alias("coarse")))
    pins = hg.pins.join(own, "v").select("net", F.col("coarse").alias("v")).distinct()
    several = pins.groupBy("net").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("net")
    pins = settle(pins.join(several, "net", "left_semi"))
    merged = settle(equal_nets(pins))
    kept = merged.where("net = into").select("net")
    weight = hg.nets.join(merged, "net").groupBy(F.col("into").alias("net")).agg(F.sum("weight").cast("int").alias("weight"))
    source = hg.nets.join(kept, "net", "left_semi").join(own.withColumnRenamed("v", "src"), "src", "left").select("net", F.col("coarse").alias("src"))
    vertices = own.groupBy(F.col("coarse").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    coarse = Hypergraph(settle(pins.join(kept, "net", "left_semi").select("net", "v")), vertices.select("v"), settle(weight.join(source, "net")))
    return Coarse(coarse, vertices, merged)


def projected(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(v, part) of the vertices from the parts of their groups (v, coarse)."""
    return groups.join(parts.select(F.col("v").alias("coarse"), "part"), "coarse", "left").select("v", "part")


def weighted_cut(hg: Hypergraph, parts: DataFrame) -> DataFrame:
    """One row: weight of the cut nets, and weight times (parts - 1) summed up."""
    own = connectivity(net_part(hg.pins, parts)).join(hg.nets.select("net", "weight"), "net")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    return own.agg(total(F.when(F.col("lam") > 1, F.col("weight"))).alias("cn"), total(F.col("weight") * (F.col("lam") - 1)).alias("tv"))
