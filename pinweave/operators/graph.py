"""Degrees, CSR forms, thinning, sources, breadth-first levels and orders, and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.functions.expressions import renumbered, running_total
from pinweave.model import Hypergraph, settled
from pinweave.store import settle


def net_degree(hg: Hypergraph) -> DataFrame:
    """(net, degree), 0 for nets without pins."""
    own = hg.pins.groupBy("net").agg(F.count(F.lit(1)).alias("degree"))
    return hg.nets.select("net").join(own, "net", "left").select("net", F.coalesce("degree", F.lit(0)).alias("degree"))


def vertex_degree(hg: Hypergraph) -> DataFrame:
    own = hg.pins.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    return hg.vertices.join(own, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.count(F.lit(1)).alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.sum("degree").alias("pins"), F.avg("degree").alias("mean"))


def csr(pins: DataFrame, major: str = "net") -> DataFrame:
    """(major, members): the sorted other ends of each."""
    minor = "v" if major == "net" else "net"
    return pins.groupBy(major).agg(F.array_sort(F.collect_list(minor)).alias("members"))


def csr_offsets(pins: DataFrame, major: str = "net") -> DataFrame:
    """(major, degree, start): the exclusive prefix sum of the degrees."""
    return running_total(pins.groupBy(major).agg(F.count(F.lit(1)).alias("degree")), major, "degree", "start")


def thin(hg: Hypergraph, mean_factor: float = 0, least: float = 0) -> Hypergraph:
    """Keeps nets with degree < mean_factor * mean and degree < least; all vertices stay.

    The defaults of 0 drop every net. Net ids are kept; ``thin_numbers`` gives the dense ones.
    """
    degrees = net_degree(hg)
    mean = degrees.agg((F.sum("degree") / F.count(F.lit(1))).alias("mean"))
    kept = degrees.crossJoin(mean).where((F.col("degree") < mean_factor * F.col("mean")) & (F.col("degree") < least)).select("net")
    return Hypergraph(hg.pins.join(kept, "net", "left_semi"), hg.vertices, hg.nets.join(kept, "net", "left_semi"))


def thin_numbers(thinned: Hypergraph) -> DataFrame:
    """(net, number): dense numbers from 0 in the order of the ids."""
    return renumbered(thinned.nets.select("net"), "net", "number")


def source_split(hg: Hypergraph) -> DataFrame:
    """(v, is_source): whether a vertex is the source of some net."""
    sources = hg.nets.where("src is not null").select(F.col("src").alias("v")).distinct().withColumn("is_source", F.lit(True))
    return hg.vertices.join(sources, "v", "left").select("v", F.coalesce("is_source", F.lit(False)).alias("is_source"))


def top_down(pins: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """One level: the vertices on a net of the frontier that were not seen."""
    nets = pins.join(frontier.select("v"), "v", "left_semi").select("net").distinct()
    return pins.join(nets, "net", "left_semi").select("v").distinct().join(seen.select("v"), "v", "left_anti")


def bfs(hg: Hypergraph, start: int | None = None) -> DataFrame:
    """(v, level): hops over common nets from start, the lowest vertex by default; null if not reachable.

    Level-synchronous; each level is written to the shared folder.
    """
    spark = hg.pins.sparkSession
    if start is None:
        start = hg.vertices.agg(F.min("v")).first()[0]
    if start is None:
        return hg.vertices.select("v", F.lit(None).cast("int").alias("level"))
    pins = settle(hg.pins)
    frontier = settle(spark.createDataFrame([(start, 0)], "v bigint, level int"))
    levels = [frontier]
    while not frontier.isEmpty():
        # What was seen and stands on a net of the frontier is in this level or the one before.
        seen = reduce(DataFrame.unionByName, levels[-2:])
        frontier = settle(top_down(pins, frontier, seen).withColumn("level", F.lit(len(levels))))
        levels.append(frontier)
    return hg.vertices.join(reduce(DataFrame.unionByName, levels), "v", "left").select("v", "level")


def farthest(levels: DataFrame) -> DataFrame:
    """One row (v, level): the farthest reachable vertex, the lowest on ties."""
    low = F.struct(F.col("level"), (-F.col("v")).alias("low"))
    return levels.where("level is not null").agg(F.max_by("v", low).alias("v"), F.max("level").alias("level"))


def bfs_order(levels: DataFrame) -> DataFrame:
    """(v, ord): by level, then id, unreachable vertices last by id."""
    own = levels.select("v", F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "v").alias("place"))
    return renumbered(own, "place", "ord").select("v", "ord")


def bfs_queue_order(hg: Hypergraph, start: int | None = None) -> DataFrame:
    """(v, ord): the order in which a breadth-first search with a queue comes to the vertices, unreachable ones last by id.

    Such a search takes a vertex's nets, and a net's pins, by id. So a net is gone through from the first of its vertices
    in the queue, and within a level vertices are in the order of (that one's place, net, id) of the first net that they
    are on: one aggregate by net, one by vertex, and a numbering within the level.
    """
    spark = hg.pins.sparkSession
    if start is None:
        start = hg.vertices.agg(F.min("v")).first()[0]
    if start is None:
        return hg.vertices.select("v", F.lit(None).cast("bigint").alias("ord"))
    pins = settle(hg.pins)
    frontier = settle(spark.createDataFrame([(start, 0)], "v bigint, ord bigint"))
    levels, placed, n = [frontier], 1, 1
    while n:
        first = pins.join(frontier, "v").groupBy("net").agg(F.min("ord").alias("since"))
        seen = reduce(DataFrame.unionByName, levels[-2:]).select("v")
        new = pins.join(first, "net").groupBy("v").agg(F.min(F.struct("since", "net")).alias("by")).join(seen, "v", "left_anti")
        ordered = renumbered(new.select("v", F.struct("by", "v").alias("place")), "place", "number")
        frontier = settle(ordered.select("v", (F.col("number") + placed).alias("ord")))
        n = frontier.count()
        placed += n
        levels.append(frontier)
    reached = reduce(DataFrame.unionByName, levels)
    rest = renumbered(hg.vertices.join(reached, "v", "left_anti"), "v", "number").select("v", (F.col("number") + placed).alias("ord"))
    return reached.unionByName(rest)


def bfs_order_split(levels: DataFrame, split: DataFrame) -> DataFrame:
    """(v, is_source, ord): the order within sources and within the other vertices, each from 0.

    Both orders run over the whole one: a vertex's place is the number of its own kind before it.
    """
    own = bfs_order(levels).join(split, "v").withColumn("one", F.col("is_source").cast("bigint"))
    placed = running_total(own, "ord", "one", "sources")
    return placed.select("v", "is_source", F.when(F.col("is_source"), F.col("sources")).otherwise(F.col("ord") - F.col("sources")).alias("ord"))


def pseudo_peripheral(hg: Hypergraph) -> tuple[int, DataFrame]:
    """The farthest vertex from the farthest of the lowest vertex, and the levels from it."""
    hg = settled(hg)
    first = farthest(bfs(hg)).first()[0]
    second = farthest(bfs(hg, first)).first()[0]
    return second, bfs(hg, second)


def id_order(hg: Hypergraph) -> DataFrame:
    """(v, ord): by id."""
    return renumbered(hg.vertices, "v", "ord")


def order(hg: Hypergraph, kind: int = 0) -> DataFrame:
    """(v, ord): 0 by id, 1 breadth-first from a pseudo-peripheral vertex."""
    if kind not in (0, 1):
        raise ValueError(f"an order is 0 (by id) or 1 (breadth-first), not {kind}")
    return bfs_order(pseudo_peripheral(hg)[1]) if kind else id_order(hg)


def majority_colour(hg: Hypergraph, colours: DataFrame) -> DataFrame:
    """(net, colour): the most frequent colour among a net's pins, the lowest on ties."""
    counts = hg.pins.join(colours, "v").groupBy("net", "colour").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("net").agg(F.max_by("colour", F.struct("n", (-F.col("colour")).alias("low"))).alias("colour"))


def colour_step(hg: Hypergraph, colours: DataFrame) -> DataFrame:
    """(v, colour) after one round: each vertex takes the majority colour of its highest net.

    That is the last to write when nets overwrite their pins in turn; vertices without nets keep their colour.
    """
    last = hg.pins.join(majority_colour(hg, colours), "net").groupBy("v").agg(F.max_by("colour", "net").alias("new"))
    return colours.join(last, "v", "left").select("v", F.coalesce("new", "colour").alias("colour"))
