"""Connected components by alternating star contractions, and the largest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.model import Hypergraph
from pinweave.store import Rounds

#: A key with over one in so many of all rows is broadcast in place of shuffled with all its rows to one task.
HUBS = 1000


def with_key(rows: DataFrame, table: DataFrame, key: str, hot: int) -> DataFrame:
    """rows joined with a table of one row a key that says in ``n`` how many rows have it.

    There are at most as many keys of over ``hot`` rows, which are broadcast, as ``hot`` goes into the rows.
    """
    heavy = F.broadcast(table.where(F.col("n") > hot).drop("n"))
    light = table.where(F.col("n") <= hot).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _large(edges: DataFrame, hot: int) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the least of the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    return with_key(both.where("b > a"), least, "a", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, hot: int) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = with_key(down, least, "a", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) with b the least vertex of a's component, for every vertex of the links but the least ones.

    Rounds go on until a round changes nothing; their number grows with the logarithm of the longest chain. Each round
    is written to the shared folder and the one before it deleted.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.settle("edges", edges.select("a", "b").where("a <> b").distinct())
    before, n = None, edges.count()
    while True:
        hot = max(n // HUBS, HUBS)
        large = rounds.settle("large", _large(edges, hot))
        edges = rounds.settle("edges", _small(large, hot))
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            rounds.close("edges")
            return edges
        before = (n, total)


def connected_components(hg: Hypergraph) -> DataFrame:
    """(v, component): the lowest vertex reachable over common nets.

    A net links its pins to the lowest of them, so there are fewer links than pins.
    """
    degrees = hg.pins.groupBy("net").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n"))
    pins = hg.pins.count()
    edges = with_key(hg.pins, degrees, "net", max(pins // HUBS, HUBS)).select(F.col("v").alias("a"), "b")
    found = stars(edges).select(F.col("a").alias("v"), F.col("b").alias("component"))
    return hg.vertices.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def largest_component(hg: Hypergraph) -> Hypergraph:
    """The part of the hypergraph in the component of most vertices, of equal ones that with the lowest vertex."""
    labels = Rounds(hg.pins.sparkSession).settle("labels", connected_components(hg))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max_by("component", F.struct("n", (-F.col("component")).alias("low"))).alias("component"))
    vertices = labels.join(F.broadcast(best), "component").select("v")
    pins = hg.pins.join(vertices, "v", "left_semi").select("net", "v")
    return Hypergraph(pins, vertices, hg.nets.join(pins.select("net").distinct(), "net", "left_semi"))
