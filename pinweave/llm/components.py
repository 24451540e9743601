"""Connected components by alternating star contractions, each round two shuffles of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import stored

#: Rows of a task of a round, so that small rounds do not have a task for each of very many partitions.
ROWS = 100_000


def sized(rows: DataFrame, n: int) -> DataFrame:
    """The same rows in no more partitions than n rows need."""
    return rows.coalesce(n // ROWS + 1)


def _with_least(rows: DataFrame, least: DataFrame, hot: int, n: int) -> DataFrame:
    """(a, b, m): each row with the least m of its a, given as (a, m, n) with the number n of a's rows.

    Nodes with over ``hot`` rows are broadcast in place of shuffling all their rows to one task; there are at most as many
    of them as ``hot`` goes into the rows.
    """
    light = least.where(F.col("n") <= hot).select("a", "m")
    if n <= hot:
        return sized(rows.join(light, "a"), n)
    heavy = F.broadcast(least.where(F.col("n") > hot).select("a", "m"))
    return sized(rows.join(heavy, "a"), n).unionByName(sized(rows.join(heavy.select("a"), "a", "left_anti").join(light, "a"), n))


def _large(edges: DataFrame, hot: int, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sized(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")), 2 * n)
    return sized(_with_least(both.where("b > a"), least, hot, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), n)


def _small(edges: DataFrame, hot: int, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sized(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), n)
    joined = _with_least(down, least, hot, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return sized(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), n)


def components(edges: DataFrame, rounds: int = 60, hubs: int = 1000) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Each round is written to the shared folder, which cuts the lineage; the rounds grow with the logarithm of the
    longest chain. A node with over one in ``hubs`` of all links, as the middle of a large component, is no key of a
    shuffle: at most ``hubs`` such nodes are broadcast. No links give no rows; a link of a node with itself or with
    null is none, and repeated links count once.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    before, n = None, edges.count()
    edges = sized(edges, n)
    for _ in range(rounds):
        hot = max(n // hubs, hubs)
        edges = stored(_small(stored(_large(edges, hot, n)), hot, n))
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").distinct().toDF("node", "root"))
        before = (n, total)
    raise RuntimeError(f"no fixed point in {rounds} rounds")
