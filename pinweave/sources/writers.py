"""Writers. Text comes out in order over many files, whose names are in order, too, or in one with ``single``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.model import Hypergraph, header
from pinweave.ship import ship
from pinweave.sources.readers import packed_size, place_of

#: Places of a matrix as an array that are written together, and those of a file (16 MB of zeros before compression).
RUN, PER_FILE = 1 << 16, 1 << 22


def _text(rows: DataFrame, key: str, path: str, single: bool) -> None:
    ordered = (rows.coalesce(1).sortWithinPartitions(key) if single else rows.orderBy(key)).select("value")
    ordered.write.mode("overwrite").text(path)


def write_parts(parts: DataFrame, path: str, single: bool = False) -> None:
    """One part a line in the order of the vertices; -1 where a vertex has none."""
    _text(parts.select("v", F.coalesce("part", F.lit(-1)).cast("string").alias("value")), "v", path, single)


def part_path(source: str, k: int) -> str:
    """Where the part vector of an input goes by default."""
    return f"{source}.parts.{k}"


def hypergraph_lines(hg: Hypergraph, base: int = 0) -> DataFrame:
    """(net, value): the header as net -1 and the pins of each net; a net without pins has an empty line."""
    shift = 1 if base else 0
    lines = hg.pins.groupBy("net").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: (v + shift).cast("string")), " ").alias("value"))
    lines = hg.nets.select("net").join(lines, "net", "left").select("net", F.coalesce("value", F.lit("")).alias("value"))
    top = header(hg).select(F.lit(-1).cast("bigint").alias("net"), F.concat_ws(" ", F.lit(str(base)), "nov", "noe", "pins").alias("value"))
    return top.unionByName(lines)


def write_hypergraph(hg: Hypergraph, path: str, base: int = 0, single: bool = False) -> None:
    _text(hypergraph_lines(hg, base), "net", path, single)


def write_vertex_major(hg: Hypergraph, path: str, single: bool = False) -> None:
    """``nov noe pins``, then the net ids of each vertex, a line each; ids are 0, 1, 2, ... on both sides."""
    lines = hg.pins.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list("net")), lambda n: n.cast("string")), " ").alias("value"))
    lines = hg.vertices.select("v").join(lines, "v", "left").select("v", F.coalesce("value", F.lit("")).alias("value"))
    top = header(hg).select(F.lit(-1).cast("bigint").alias("v"), F.concat_ws(" ", "nov", "noe", "pins").alias("value"))
    _text(top.unionByName(lines), "v", path, single)


def write_matrix(side: int, entries: DataFrame, path: str, single: bool = False) -> None:
    """Entries (i, j, w), from 0, as a general real matrix in Matrix Market form."""
    top = entries.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("bigint").alias("i"), F.concat(F.lit(f"%%MatrixMarket matrix coordinate real general\n{side} {side} "), F.col("n")).alias("value"))
    _text(top.unionByName(entries.select(F.col("i").cast("bigint").alias("i"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "w").alias("value"))), "i", path, single)


def write_array(side: int, entries: DataFrame, path: str, symmetry: str = "general", single: bool = False) -> None:
    """Entries (i, j, w), from 0, each once, as a real matrix in array form; of a symmetric one the lower triangle counts.

    Only entries are shuffled, with one row for each ``RUN`` places; the task that writes the places of a run puts the
    zeros between. Text over many files is compressed, as it is as long as the side is squared.
    """
    spark, total = entries.sparkSession, packed_size(side, symmetry)
    own = entries.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "w").where(F.col("i").between(0, side - 1) & F.col("j").between(0, side - 1))
    values = own.select(place_of(F.col("i"), F.col("j"), side, symmetry).alias("place"), F.coalesce("w", F.lit(0.0)).cast("double").cast("string").alias("value")).where("place is not null")
    runs = spark.range(0, total, RUN).select(F.col("id").alias("place"), F.lit(None).cast("string").alias("value"))
    top = spark.range(1).select(F.lit(-1).cast("bigint").alias("place"), F.lit(f"%%MatrixMarket matrix array real {symmetry}\n{side} {side}").alias("value"))
    rows = top.unionByName(runs).unionByName(values).withColumn("run", F.floor(F.col("place") / RUN))
    ranged = rows.coalesce(1) if single else rows.repartitionByRange(max(1, -(-total // PER_FILE)), "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, size, at, stop = [], 0, 0, 0
        zero = "0.0\n" * RUN
        for batch in batches:
            for place, value in zip(batch.column("place").to_pylist(), batch.column("value").to_pylist()):
                text.append(zero[: 4 * ((stop if value is None else place) - at)] if place >= 0 else "")
                size += len(text[-1])
                if value is None:
                    at, stop = place, min(place + RUN, total)
                else:
                    text.append(value + "\n")
                    at = place + 1
                if size > 1 << 20 or len(text) > 1 << 16:
                    if size := sum(map(len, text)):
                        yield pa.RecordBatch.from_arrays([pa.array(["".join(text)[:-1]])], ["value"])
                    text, size = [], 0
        text.append(zero[: 4 * (stop - at)])
        if any(text):
            yield pa.RecordBatch.from_arrays([pa.array(["".join(text)[:-1]])], ["value"])

    ship(spark)
    lines = ranged.sortWithinPartitions("place", "value").select("place", "value").mapInArrow(run, "value string")
    lines.write.mode("overwrite").option("compression", "none" if single else "gzip").text(path)


def write_graph(side: int, entries: DataFrame, path: str, weights: DataFrame | None = None, single: bool = False) -> None:
    """Symmetric entries (i, j, w) with whole weights, and weights (v, weight) of the vertices, as a graph file."""
    spark = entries.sparkSession
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("w").cast("bigint").alias("w")))), lambda e: F.concat_ws(" ", e["j"] + 1, e["w"]))
    lines = spark.range(side).select(F.col("id").alias("v")).join(entries.groupBy(F.col("i").alias("v")).agg(F.array_join(pairs, " ").alias("value")), "v", "left")
    if weights is not None:
        lines = lines.join(weights, "v", "left").select("v", F.concat_ws(" ", F.coalesce("weight", F.lit(1)), "value").alias("value"))
    top = entries.agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n")).select(F.lit(-1).cast("bigint").alias("v"), F.concat_ws(" ", F.lit(str(side)), "n", F.lit("1" if weights is None else "11")).alias("value"))
    _text(top.unionByName(lines.select("v", F.coalesce("value", F.lit("")).alias("value"))), "v", path, single)


def write_weights(nets: DataFrame, path: str, single: bool = False) -> None:
    """``weight source`` for each net, -1 for no source."""
    _text(nets.select("net", F.concat_ws(" ", "weight", F.coalesce("src", F.lit(-1))).alias("value")), "net", path, single)


def write_cache(hg: Hypergraph, path: str) -> None:
    """Parquet tables, for ``read_cache``."""
    for name in ("pins", "vertices", "nets"):
        getattr(hg, name).write.mode("overwrite").parquet(f"{path}/{name}")


def write_graph_cache(weights: DataFrame, entries: DataFrame, path: str) -> None:
    """Parquet tables of a graph with the weights of its vertices, for ``read_graph_cache``."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    entries.write.mode("overwrite").parquet(f"{path}/entries")
