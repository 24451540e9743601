"""Hypergraphs of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.functions.expressions import modulo_part, skewed_part, tilted_part
from pinweave.model import Hypergraph, transpose


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_parts(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Nets are orders, vertices the products in them."""
    return Hypergraph.of(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_partkey").alias("v")))


def parts_orders(spark: SparkSession, sf_dir: str) -> Hypergraph:
    return transpose(orders_parts(spark, sf_dir))


def orders_suppliers(spark: SparkSession, sf_dir: str) -> Hypergraph:
    return Hypergraph.of(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_suppkey").alias("v")))


def users_events(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Nets are users, vertices the kinds of their events, numbered by name: nearly every net has all vertices."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    below = kinds.select(F.col("event_type").alias("other"))
    number = kinds.join(F.broadcast(below), F.col("other") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("other").alias("v"))
    return Hypergraph.of(events.join(number, "event_type").select(F.col("user_id").alias("net"), "v"))


def modulo(hg: Hypergraph, k: int) -> DataFrame:
    return hg.vertices.select("v", modulo_part("v", k).alias("part"))


def skewed(hg: Hypergraph, k: int) -> DataFrame:
    return hg.vertices.select("v", skewed_part("v", k).alias("part"))


def tilted(hg: Hypergraph, k: int = 8) -> DataFrame:
    return hg.vertices.select("v", tilted_part("v").alias("part"))
