"""The six communication metrics and what they are made of.

Everything follows from ``net_part``, the pins of each net in each part: one join of the pins with the parts and one
aggregation. The message table has at most K * K rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.functions.expressions import improvement
from pinweave.model import Hypergraph
from pinweave.store import settle

NAMES = ("cn", "tv", "tm", "msm", "msv", "msrv")


def net_part(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """(net, part, cnt): pins of the net in the part; vertices without a part count nowhere."""
    return pins.join(parts.where("part is not null"), "v").groupBy("net", "part").agg(F.count(F.lit(1)).alias("cnt"))


def connectivity(np: DataFrame) -> DataFrame:
    """(net, lam): parts that the net touches."""
    return np.groupBy("net").agg(F.count(F.lit(1)).alias("lam"))


def sourced(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(net, src, sp): the part of each net's source; nets without source or with one that has no part are left out."""
    return nets.where("src is not null").join(parts.where("part is not null").select(F.col("v").alias("src"), F.col("part").alias("sp")), "src").select("net", "src", "sp")


def messages(np: DataFrame, sources: DataFrame) -> DataFrame:
    """(sp, tp, mult): nets with their source in sp that touch tp, another part."""
    return np.join(sources.select("net", "sp"), "net").where("sp <> part").groupBy("sp", F.col("part").alias("tp")).agg(F.count(F.lit(1)).alias("mult"))


def cut_net(np: DataFrame) -> DataFrame:
    return connectivity(np).agg(F.coalesce(F.sum((F.col("lam") > 1).cast("bigint")), F.lit(0)).alias("cn"))


def total_volume(np: DataFrame) -> DataFrame:
    return connectivity(np).agg(F.coalesce(F.sum(F.col("lam") - 1), F.lit(0)).alias("tv"))


def total_message(msg: DataFrame) -> DataFrame:
    return msg.agg(F.count(F.lit(1)).alias("tm"))


def max_send_message(msg: DataFrame) -> DataFrame:
    return msg.groupBy("sp").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("msm"))


def per_part(hg: Hypergraph, parts: DataFrame, k: int) -> DataFrame:
    """(part, send, recv, sent_messages, received_messages) for all K parts.

    A part sends lambda - 1 for each net whose source is a pin in it, and receives once for each net that touches it with
    the source elsewhere.
    """
    np = net_part(hg.pins, parts)
    sources = sourced(hg.nets, parts)
    msg = messages(np, sources)
    is_pin = hg.pins.join(hg.nets.select("net", F.col("src").alias("v")), ["net", "v"], "left_semi").select("net")
    send = connectivity(np).join(sources.join(is_pin, "net", "left_semi"), "net").groupBy(F.col("sp").alias("part")).agg(F.sum(F.col("lam") - 1).alias("send"))
    sent = msg.groupBy(F.col("sp").alias("part")).agg(F.count(F.lit(1)).alias("sent_messages"))
    received = msg.groupBy(F.col("tp").alias("part")).agg(F.sum("mult").alias("recv"), F.count(F.lit(1)).alias("received_messages"))
    all_parts = hg.pins.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    return all_parts.join(send, "part", "left").join(sent, "part", "left").join(received, "part", "left").select("part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("send", "recv", "sent_messages", "received_messages")])


def report(hg: Hypergraph, parts: DataFrame) -> DataFrame:
    """One row with all six metrics, in one pass over the pins.

    Each net is reduced to the set of parts it touches, K values at most, with its source's part. The sums over (source
    part, touched part) pairs, at most 2 K (K + 1) rows, are merged by all tasks and written to the shared folder, so that
    what is drawn from them neither reads the pins again nor waits for one task that merges every task's sums.
    """
    own = hg.pins.join(parts.where("part is not null"), "v").join(hg.nets.select("net", "src"), "net", "left")
    net = own.groupBy("net").agg(F.collect_set("part").alias("touched"), F.max(F.when(F.col("v") == F.col("src"), F.col("part"))).alias("pin_sp"), F.max("src").alias("src"))
    net = net.join(parts.select(F.col("v").alias("src"), F.col("part").alias("sp")), "src", "left").withColumn("lam", F.size("touched").cast("bigint"))
    # (sender, receiver) rows with sums; receiver null carries what belongs to the net as a whole.
    flat = net.select("sp", "pin_sp", "lam", F.explode(F.concat(F.array(F.lit(None).cast("int")), "touched")).alias("tp"))
    whole = F.col("tp").isNull()
    pair = settle(flat.groupBy("sp", "pin_sp", "tp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(whole, F.col("lam") - 1)).alias("volume"),
        F.sum(F.when(whole & (F.col("lam") > 1), 1)).alias("cut"),
    ))
    message = pair.where("tp is not null and sp is not null and sp <> tp").groupBy("sp", "tp").agg(F.sum("n").alias("mult"))
    by_part = message.groupBy(F.col("sp").alias("part")).agg(F.count(F.lit(1)).alias("sent"))
    send = pair.where("tp is null and pin_sp is not null").groupBy(F.col("pin_sp").alias("part")).agg(F.sum("volume").alias("send"))
    receive = message.groupBy(F.col("tp").alias("part")).agg(F.sum("mult").alias("recv"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    parts_ = send.join(receive, "part", "full").join(by_part, "part", "full").agg(
        zero(F.sum("sent")).alias("tm"), zero(F.max("sent")).alias("msm"), zero(F.max("send")).alias("msv"), zero(F.max(zero(F.col("send")) + zero(F.col("recv")))).alias("msrv")
    )
    nets = pair.where("tp is null").agg(zero(F.sum("cut")).alias("cn"), zero(F.sum("volume")).alias("tv"))
    return nets.crossJoin(parts_).select(*NAMES)


def part_sizes(parts: DataFrame, k: int) -> DataFrame:
    """(part, size) of all K parts."""
    own = parts.where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    return parts.sparkSession.range(k).select(F.col("id").cast("int").alias("part")).join(own, "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))


def imbalance(parts: DataFrame, k: int) -> DataFrame:
    """The largest part over the mean of all K, empty ones too."""
    return part_sizes(parts, k).agg((F.max("size") / F.avg("size")).alias("imbalance"))


def compare(hg: Hypergraph, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the six metrics of both partitions and the improvement of each in percent."""
    a = report(hg, before).toDF(*[f"{n}_before" for n in NAMES])
    b = report(hg, after).toDF(*[f"{n}_after" for n in NAMES])
    return a.crossJoin(b).select("*", *[improvement(F.col(f"{n}_before"), F.col(f"{n}_after")).alias(f"{n}_improvement") for n in NAMES])
