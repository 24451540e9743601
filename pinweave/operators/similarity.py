"""An order that brings vertices with similar nets together, by MinHash signatures cut in bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinweave.functions.expressions import renumbered
from pinweave.model import Hypergraph
from pinweave.operators.components import stars
from pinweave.store import settle

#: The modulus of the hashes, a prime below 2**31, so that products of two residues fit a bigint.
PRIME = 2**31 - 1


def coefficients(k: int) -> tuple[int, int]:
    """Of the k-th hash a * net + b, powers of two primitive roots."""
    return pow(48271, k + 1, PRIME), pow(16807, k + 1, PRIME)


def _hash(net: Column, k: int) -> Column:
    a, b = coefficients(k)
    return (F.pmod(net, F.lit(PRIME)) * a + b) % PRIME


def signatures(hg: Hypergraph, size: int) -> DataFrame:
    """(v, signature): the least of each of ``size`` hashes over the vertex's nets; vertices without nets have none.

    Two vertices agree in an entry with the probability that their net sets have in common, intersection by union.
    """
    least = hg.pins.groupBy("v").agg(*[F.min(_hash(F.col("net"), k)).alias(f"h{k}") for k in range(size)])
    return least.select("v", F.array(*[f"h{k}" for k in range(size)]).alias("signature"))


def buckets(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(v, band, key): a bucket for each band of ``rows`` entries; vertices that agree in a whole band share one."""
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.slice("signature", b * rows + 1, rows).alias("key")))
    return signed.select("v", F.explode(band).alias("b")).select("v", "b.band", "b.key")


def similarity_order(hg: Hypergraph, bands: int = 16, rows: int = 2) -> DataFrame:
    """(v, ord): chains of vertices that share a bucket stand together, in the order of their signatures, then ids.

    A bucket links its vertices to the lowest one, so there are as many links as vertices and bands at most. Vertices
    without nets come last.
    """
    if bands < 1 or rows < 1:
        raise ValueError(f"bands and rows are at least 1, not {bands} and {rows}")
    signed = settle(signatures(hg, bands * rows))
    filled = settle(buckets(signed, bands, rows))
    lowest = filled.groupBy("band", "key").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    chains = stars(filled.join(lowest, ["band", "key"]).select(F.col("v").alias("a"), "b"))
    chained = signed.join(chains.select(F.col("a").alias("v"), F.col("b").alias("chain")), "v", "left").select("v", F.coalesce("chain", "v").alias("chain"), "signature")
    every = hg.vertices.join(chained, "v", "left").select("v", F.struct(F.col("signature").isNull().alias("last"), "chain", "signature", "v").alias("place"))
    return renumbered(every, "place", "ord").select("v", "ord")
