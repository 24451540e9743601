"""The hypergraph as tables.

``pins(net, v)`` holds each incidence once, ``nets(net, weight, src)`` every net, also one without pins, and
``vertices(v)`` every vertex. A partition is ``parts(v, part)``, its part null where a vertex has none yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.store import settle


@dataclass(frozen=True)
class Hypergraph:
    pins: DataFrame
    vertices: DataFrame
    nets: DataFrame

    @classmethod
    def of(cls, pins: DataFrame, vertices: DataFrame | None = None, nets: DataFrame | None = None) -> Hypergraph:
        """From pins alone or with tables that also list what has no pin; repeated and null pins are left out.

        The source of a net is its lowest pin unless ``nets`` gives one, its weight 1.
        """
        pins = pins.select(F.col("net").cast("bigint"), F.col("v").cast("bigint")).dropna().distinct()
        lowest = pins.groupBy("net").agg(F.min("v").alias("low"))
        if nets is None:
            nets = lowest.select("net", F.lit(1).alias("weight"), F.col("low").alias("src"))
        else:
            weight = F.col("weight") if "weight" in nets.columns else F.lit(1)
            src = F.coalesce("src", "low") if "src" in nets.columns else F.col("low")
            nets = nets.join(lowest, "net", "left").select("net", weight.cast("int").alias("weight"), src.cast("bigint").alias("src"))
        vertices = pins.select("v").distinct() if vertices is None else vertices.select(F.col("v").cast("bigint"))
        return cls(pins, vertices, nets)


def settled(hg: Hypergraph) -> Hypergraph:
    """The same with its tables written once, for what reads them more than once; sources and vertices follow the pins."""
    return Hypergraph(settle(hg.pins), settle(hg.vertices), settle(hg.nets))


def transpose(hg: Hypergraph) -> Hypergraph:
    """The dual: vertices become nets and nets vertices."""
    pins = hg.pins.select(F.col("v").alias("net"), F.col("net").alias("v"))
    return Hypergraph.of(pins, hg.nets.select(F.col("net").alias("v")), hg.vertices.select(F.col("v").alias("net")))


def header(hg: Hypergraph) -> DataFrame:
    """One row: nov, noe and pins."""
    return hg.vertices.agg(F.count("v").alias("nov")).crossJoin(hg.nets.agg(F.count("net").alias("noe"))).crossJoin(hg.pins.agg(F.count("v").alias("pins")))


def validate(raw: DataFrame, nov: int | None = None) -> DataFrame:
    """One row of faults among raw (net, v): repeated pins, nulls, ids below 0 and, given nov, ids of nov or more."""
    each = raw.groupBy("net", "v").agg(F.count(F.lit(1)).alias("n"))
    bad = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    return each.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("repeated"),
        bad(F.col("net").isNull() | F.col("v").isNull()).alias("nulls"),
        bad((F.col("net") < 0) | (F.col("v") < 0)).alias("negative"),
        bad((F.col("v") >= nov) if nov is not None else F.lit(False)).alias("beyond"),
    )


def check_parts(k: int) -> None:
    if k <= 1:
        raise ValueError(f"a partition needs more than one part, not {k}")
