"""Command line: ``python -m pinweave.cli partition ...`` and ``convert``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pinweave.model import check_parts
from pinweave.operators import graph, metrics, place, refine
from pinweave.sources import readers, writers
from pinweave.store import exists, settle

#: The placement policy of each objective.
POLICY = {"cn": "cn", "tv": "tv", "tm": "tm", "msm": "tm", "msv": "tv", "msrv": "tv"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pinweave")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("partition", help="place, refine, report and write the parts")
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-m", "--metric", choices=sorted(POLICY), default="tv")
    p.add_argument("-k", "--parts", type=int, default=2)
    p.add_argument("-o", "--order", type=int, default=0, help="0 by id, 1 breadth-first")
    p.add_argument("-r", "--refine", action="store_true")
    p.add_argument("-i", "--sweeps", type=int, default=1)
    p.add_argument("--mode", choices=("sweep", "batch", "colour"), default="sweep", help="refine all vertices at once, in runs of their ids, or in classes that share no net")
    p.add_argument("--refine-batch", type=int, default=100_000, help="vertices of a run")
    p.add_argument("--cache", action="store_true", help="keep the hypergraph as Parquet beside its file; a cache there is always read first")
    p.add_argument("--single", action="store_true", help="write the parts as one file")
    p.add_argument("-b", "--batch", type=int, default=0, help="vertices placed at a time; 0 one by one")
    p.add_argument("--orientation", choices=("net", "vertex"), default="net")
    p.add_argument("--weights", help="file with a line of weight and source for each net")
    p.add_argument("--thin", action="store_true", help="place on nets below both limits only")
    p.add_argument("--thin-least", type=float, default=0)
    p.add_argument("--thin-mean", type=float, default=0)
    p.add_argument("--out", help="folder of the part vector")
    c = commands.add_parser("convert", help="a matrix or graph file to a hypergraph file")
    c.add_argument("-f", "--file", required=True)
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--base", type=int, choices=(0, 1), default=0)
    return top


def partition(spark: SparkSession, a: argparse.Namespace) -> None:
    check_parts(a.parts)
    hg = readers.load(spark, a.file, a.orientation)
    if a.cache and a.file.endswith(".hg") and not exists(spark, readers.cache_path(a.file)):
        writers.write_cache(hg, readers.cache_path(a.file))
        hg = readers.read_cache(spark, readers.cache_path(a.file))
    if a.weights:
        hg = type(hg).of(hg.pins, hg.vertices, readers.read_weights(spark, a.weights))
    order = settle(graph.order(hg, a.order))
    own = graph.thin(hg, a.thin_mean, a.thin_least) if a.thin else hg
    policy = POLICY[a.metric]
    parts = place.place_batches(own, order, a.parts, policy, a.batch) if a.batch else settle(place.place(own, order, a.parts, policy))
    if a.refine:
        refined = refine.refine(hg, parts, a.parts, a.metric, a.sweeps, mode=a.mode, batch=a.refine_batch)
        metrics.compare(hg, parts, refined).show(vertical=True)
        parts = refined
    else:
        metrics.report(hg, parts).show(vertical=True)
    metrics.imbalance(parts, a.parts).show()
    writers.write_parts(parts, a.out or writers.part_path(a.file, a.parts), a.single)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pinweave").getOrCreate()
    if a.command == "partition":
        partition(spark, a)
    else:
        writers.write_hypergraph(readers.load(spark, a.file), a.out, a.base, single=True)


if __name__ == "__main__":
    main()
