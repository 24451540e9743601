"""Greedy placement of vertices in K balanced parts, one pass over an order.

Three policies score a part p for a vertex v:

* ``cn``: nets of v that lie wholly in p so far, times 1 - size / capacity;
* ``tv``: nets of v that touch p, times the same (also for the sent and the sent-plus-received volume);
* ``tm``: messages that go along existing connections (also for the maximum of sent messages).

Ties go to the smaller part, then the lower number; if no part scores, the least loaded one is taken.

Each decision depends on all before it. ``place`` keeps that exactly: one ordered task with the connectivity as its
state, K bits (in whole bytes) for each net with pins. ``place_batches`` scores whole batches on a frozen state with joins, which is
what to use beyond one machine's memory. What the ``tm`` rule knows between batches is which parts exchange messages, a
matrix of K * K truth values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.functions.expressions import capacity, penalised, renumbered
from pinweave.model import Hypergraph, check_parts
from pinweave.ship import ship
from pinweave.store import settle

POLICIES = ("cn", "tv", "tm")
#: Bits of a vertex's nets that are looked at together.
CHUNK = 1 << 22


class State:
    """Connectivity of what is placed so far: a bit for each net, numbered from 0, and part, in rows of whole bytes."""

    def __init__(self, k: int, limit: float, policy: str, nets: int):
        self.k, self.limit, self.policy = k, limit, policy
        self.sizes = [0] * k
        self.touched = np.zeros((nets, -(-k // 8)), np.uint8)
        if policy == "tm":
            self.source_part = np.full(nets, -1, np.int16 if k < 1 << 15 else np.int32)
            self.connected = np.zeros((k, k), dtype=bool)

    def least_loaded(self) -> int:
        return self.sizes.index(min(self.sizes))

    def touching(self, nets: np.ndarray, alone: bool = False) -> np.ndarray:
        """How many of the nets touch each part; with ``alone`` only nets that touch one part count."""
        out = np.zeros(self.k, np.int64)
        step = max(1, CHUNK // self.k)
        for lo in range(0, len(nets), step):
            bits = np.unpackbits(self.touched[nets[lo : lo + step]], axis=1, count=self.k, bitorder="little")
            out += (bits[bits.sum(axis=1, dtype=np.int64) == 1] if alone else bits).sum(axis=0, dtype=np.int64)
        return out

    def by_nets(self, nets: np.ndarray) -> int:
        if self.limit <= 0:
            return self.least_loaded()
        score = self.touching(nets, alone=self.policy == "cn").tolist()
        best = max(((s * (1 - self.sizes[p] / self.limit), -self.sizes[p], -p) for p, s in enumerate(score) if s), default=(0.0, 0, 0))
        return -best[2] if best[0] > 0 else self.least_loaded()

    def by_messages(self, nets: np.ndarray, own: np.ndarray) -> int:
        sizes = np.array(self.sizes)
        able = sizes < self.limit
        if not able.any():
            return self.least_loaded()
        senders = np.unique(self.source_part[nets[~own]])
        received = self.touching(nets[own])
        parts = np.flatnonzero(received)
        saved = self.connected[senders[senders >= 0]].sum(axis=0) + self.connected[:, parts] @ received[parts]
        most = able & (saved == saved[able].max())
        return int(np.flatnonzero(most & (sizes == sizes[most].min()))[0])

    def put(self, nets: np.ndarray, own: np.ndarray) -> int:
        """The part of the next vertex, given its nets and of which of them it is the source."""
        part = self.by_messages(nets, own) if self.policy == "tm" else self.by_nets(nets)
        self.sizes[part] += 1
        self.touched[:, part >> 3][nets] |= np.uint8(1 << (part & 7))
        if self.policy == "tm":
            self.source_part[nets[own]] = part
            self.connected[part, np.flatnonzero(self.touching(nets[own]))] = True
            senders = self.source_part[nets[~own]]
            self.connected[senders[senders >= 0], part] = True
            self.connected[part, part] = False
        return part


def check_policy(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")


def stream_rows(hg: Hypergraph, order: DataFrame) -> DataFrame:
    """(ord, v, nets): the vertices as they arrive, each with its (net, src) in the order of the nets."""
    nets = hg.pins.join(hg.nets.select("net", "src"), "net", "left").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("net", "src"))).alias("nets"))
    return order.join(nets, "v", "left").select("ord", "v", "nets")


def place(hg: Hypergraph, order: DataFrame, k: int, policy: str = "tv") -> DataFrame:
    """(v, part): the exact sequential placement.

    Vertices without nets go to the least loaded part. The number of vertices sets the capacity.
    """
    check_parts(k)
    check_policy(policy)
    ship(hg.pins.sparkSession)
    limit = capacity(hg.vertices.count(), k)

    nets = renumbered(hg.pins.select("net").distinct().join(hg.nets.select("net", "src"), "net", "left"), "net", "n").select("net", "src", "n")
    n_nets = nets.count()
    own = F.coalesce(F.col("src") == F.col("v"), F.lit(False)).cast("bigint")
    rows = hg.pins.join(nets.hint("merge"), "net").groupBy("v").agg(F.collect_list(2 * F.col("n") + own).alias("nets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(k, limit, policy, n_nets)
        for batch in batches:
            lists = batch.column("nets")
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            flat = lists.flatten().to_numpy()
            net, own = flat >> 1, (flat & 1).astype(bool)
            parts = [state.put(net[lo:hi], own[lo:hi]) for lo, hi in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(parts, pa.int32())], ["v", "part"])

    return order.join(rows, "v", "left").select("ord", "v", "nets").repartition(1).sortWithinPartitions("ord").mapInArrow(run, "v bigint, part int")


def best_by_nets(pins: DataFrame, near: DataFrame, sizes: list[int], limit: float, policy: str) -> DataFrame:
    """(v, score, part): each vertex's best part by the nets (net, part) that touch it, where any scores above 0."""
    if policy == "cn":
        near = near.join(near.groupBy("net").agg(F.count(F.lit(1)).alias("lam")).where("lam = 1").select("net"), "net", "left_semi")
    votes = pins.join(near.select("net", "part"), "net").groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"))
    scored = votes.join(_loads(pins.sparkSession, sizes), "part").withColumn("score", penalised(F.col("n"), F.col("size"), limit)).where("score > 0")
    best = scored.groupBy("v").agg(F.max(F.struct("score", (-F.col("size")).alias("size"), (-F.col("part")).alias("part"))).alias("best"))
    return best.select("v", "best.score", (-F.col("best.part")).alias("part"))


def best_by_messages(pins: DataFrame, near: DataFrame, sizes: list[int], limit: float, connected: np.ndarray) -> DataFrame:
    """(v, score, part): each vertex's part with room whose existing connections carry most of its messages, if any.

    A vertex gets messages from the parts of its nets' sources, each counted once, and sends one to each part that each
    net it is the source of touches. It is one row with at most 2 K counts; these, a row for each vertex, times the
    connections give the messages saved in every part.
    """
    k = len(sizes)
    met = pins.join(near, "net")
    senders = met.where("own = 1 and (src is null or src <> v)").select("v", "part").distinct().select("v", F.struct("part", F.lit(True).alias("sends"), F.lit(1).cast("bigint").alias("n")).alias("one"))
    receivers = met.where("src = v").groupBy("v", "part").agg(F.count(F.lit(1)).alias("n")).select("v", F.struct("part", F.lit(False).alias("sends"), "n").alias("one"))
    rows = senders.unionByName(receivers).groupBy("v").agg(F.collect_list("one").alias("partners"))
    sent = pins.sparkSession.sparkContext.broadcast((connected, np.array(sizes)))
    ship(pins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, size = sent.value[0].astype(np.float64), sent.value[1]
        able = size < limit
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            column = batch.column("partners")
            row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            part, sends, n = (column.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("part", "sends", "n"))
            counts = np.zeros((2, len(column), k))
            np.add.at(counts, (sends.astype(np.int64), row, part), n)
            saved = counts[1] @ matrix + counts[0] @ matrix.T
            saved[:, ~able] = 0
            most = saved.max(axis=1)
            load = np.where(saved == most[:, None], size, np.iinfo(np.int64).max)
            load[:, ~able] = np.iinfo(np.int64).max
            found = pa.array(most > 0)
            yield pa.RecordBatch.from_arrays([batch.column("v").filter(found), pa.array(most).filter(found), pa.array(load.argmin(axis=1).astype(np.int32)).filter(found)], ["v", "score", "part"])

    return rows.mapInArrow(run, "v bigint, score double, part int")


def _loads(spark: SparkSession, sizes: list[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(sizes)), "part int, size bigint"))


def _near(touched: DataFrame, nets: DataFrame) -> DataFrame:
    """(net, part, cnt, own) of these nets, one row for each net and part."""
    return touched.join(nets.distinct(), "net", "left_semi").groupBy("net", "part").agg(F.sum("cnt").alias("cnt"), F.max("own").alias("own"))


def place_batch(batch: DataFrame, touched: DataFrame, sizes: list[int], limit: float, policy: str = "tv", connected: np.ndarray | None = None) -> tuple[DataFrame, list[int]]:
    """(v, part) for a batch of (ord, v, nets) on a frozen state, and the sizes of the parts after it.

    ``touched`` is (net, part, cnt, own), own being 1 where the net's source is; ``sizes`` has a number for each part, and
    ``connected``, for the ``tm`` policy, says which parts exchange messages. Who has a best-scored part with room goes
    there, the best scores of a part first; all others, in their order, fill the least loaded parts one place at a time.
    """
    check_policy(policy)
    pins = batch.select("v", F.explode("nets").alias("n")).select("v", "n.net", "n.src")
    near = _near(touched, pins.select("net"))
    best = best_by_nets(pins, near, sizes, limit, policy) if policy != "tm" else best_by_messages(pins, near, sizes, limit, connected)
    asked = batch.select("ord", "v").join(best, "v", "left").join(_loads(batch.sparkSession, sizes), "part", "left")
    room = F.greatest(F.ceil(F.lit(limit)) - F.col("size"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "ord"))
    chosen = settle(asked.withColumn("fits", F.col("part").isNotNull() & (rank <= room)).select("ord", "v", F.when(F.col("fits"), F.col("part")).alias("part")))
    counts = {r["part"]: r["n"] for r in chosen.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    after = [n + counts.get(part, 0) for part, n in enumerate(sizes)]
    need = counts.get(None, 0)
    if not need:
        return chosen.select("v", "part"), after
    waiting = renumbered(chosen.where("part is null").select("ord", "v"), "ord", "place").select("v", "place")
    return chosen.where("part is not null").select("v", "part").unionByName(levelled(waiting, after)), filled(after, need)


def filled(loads: list[int], n: int) -> list[int]:
    """Loads after n more, each given to the least loaded part, the lowest number on ties."""
    first, m, level = max(s for s in _segments(loads) if s[0] <= n)
    rows, rest = divmod(n - first, m)
    out, parts = np.array(loads), np.sort(np.argsort(loads, kind="stable")[:m])
    out[parts] = level + rows
    out[parts[:rest]] += 1
    return out.tolist()


def _segments(loads: list[int]) -> list[tuple[int, int, int]]:
    """(first place, number of parts, level) from which on so many of the least loaded parts take turns."""
    order, out, first = np.sort(loads), [], 0
    for m in range(1, len(loads) + 1):
        if m == len(loads) or order[m] > order[m - 1]:
            out.append((first, m, int(order[m - 1])))
            if m < len(loads):
                first += m * int(order[m] - order[m - 1])
    return out


def levelled(waiting: DataFrame, loads: list[int]) -> DataFrame:
    """(v, part) for (v, place), places counted from 0: each goes to the part least loaded after those before it."""
    segments, order = _segments(loads), np.argsort(loads, kind="stable")
    firsts = np.array([s[0] for s in segments])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            which = np.searchsorted(firsts, place, side="right") - 1
            part = np.zeros(len(place), np.int32)
            for k in np.unique(which):
                first, m, _ = segments[k]
                own = which == k
                part[own] = np.sort(order[:m])[(place[own] - first) % m]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(part)], ["v", "part"])

    ship(waiting.sparkSession)
    return waiting.select("v", "place").mapInArrow(run, "v bigint, part int")


TOUCHED = "net bigint, part int, cnt bigint, own int"


def arrivals(batch: DataFrame, placed: DataFrame) -> DataFrame:
    """(net, part, cnt, own) of the pins of a placed batch."""
    pins = batch.select("v", F.explode("nets").alias("n")).select("v", "n.net", F.coalesce(F.col("n.src") == F.col("v"), F.lit(False)).cast("int").alias("own"))
    return pins.join(placed, "v").groupBy("net", "part").agg(F.count(F.lit(1)).alias("cnt"), F.max("own").alias("own"))


def new_connections(touched: DataFrame, new: DataFrame, k: int) -> np.ndarray:
    """K x K: the parts (sender, receiver) between which a batch ``new`` of connectivity adds messages to ``touched``.

    A net joins the one part of its source with those it touches; what comes to the driver is a list of receivers for
    each sender.
    """
    before = _near(touched, new.select("net")).select("net", "part", "own", F.lit(False).alias("fresh"))
    every = before.unionByName(new.select("net", "part", "own", F.lit(True).alias("fresh")))
    # A part that a net touched before is not fresh, but its source may have come to it now.
    every = every.groupBy("net", "part").agg(F.max("own").alias("own"), F.min("fresh").alias("fresh"), F.max(F.when(F.col("fresh"), F.col("own"))).alias("source_now"))
    sources = every.where("own = 1").select("net", F.col("part").alias("sp"), F.coalesce(F.col("source_now") == 1, F.lit(False)).alias("moved"))
    pairs = every.join(sources, "net").where("sp <> part and (fresh or moved)").groupBy("sp").agg(F.collect_set("part").alias("to"))
    out = np.zeros((k, k), dtype=bool)
    for r in pairs.toLocalIterator():
        out[r["sp"], r["to"]] = True
    return out


class Touched:
    """Connectivity as tables of (net, part, cnt, own): one more for each batch, two of one rank merged into one of the next.

    So every row is written as often as the logarithm of the batches, and there are as many tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables], self.spark.createDataFrame([], TOUCHED))

    def add(self, new: DataFrame) -> None:
        """Takes a settled table."""
        self.tables.append((0, new))
        while len(self.tables) > 1 and self.tables[-1][0] == self.tables[-2][0]:
            (rank, a), (_, b) = self.tables.pop(), self.tables.pop()
            self.tables.append((rank + 1, settle(a.unionByName(b).groupBy("net", "part").agg(F.sum("cnt").alias("cnt"), F.max("own").alias("own")))))


def place_batches(hg: Hypergraph, order: DataFrame, k: int, policy: str = "tv", batch: int = 100_000) -> DataFrame:
    """(v, part): placement in batches of the order, each scored on the state that the ones before left.

    What a batch places is written once; the sizes of the parts and, for ``tm``, the connections between them are K and
    K * K values on the driver.
    """
    check_parts(k)
    check_policy(policy)
    spark = hg.pins.sparkSession
    n = hg.vertices.count()
    limit = capacity(n, k)
    rows = settle(stream_rows(hg, order).withColumn("nets", F.coalesce("nets", F.array().cast("array<struct<net:bigint,src:bigint>>"))))
    touched, sizes, parts = Touched(spark), [0] * k, []
    connected = np.zeros((k, k), dtype=bool)
    for lo in range(0, n, batch):
        own = rows.where(F.col("ord").between(lo, lo + batch - 1))
        placed, sizes = place_batch(own, touched.table(), sizes, limit, policy, connected)
        parts.append(settle(placed))
        new = settle(arrivals(own, parts[-1]))
        if policy == "tm":
            connected |= new_connections(touched.table(), new, k)
        touched.add(new)
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "v bigint, part int"))


def audit(hg: Hypergraph, order: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Decisions of a ``tv`` trace that another part would have won; empty for a right trace.

    Every prefix is rebuilt relationally: a net touches a part from the first vertex on that it has there, a part's size
    is a running count. The scores of a vertex are joined on the parts its nets had touched before.
    """
    limit = capacity(hg.vertices.count(), k)
    trace = settle(order.join(parts, "v"))
    first = hg.pins.join(trace, "v").groupBy("net", "part").agg(F.min("ord").alias("since"))
    votes = hg.pins.join(trace.select("v", "ord"), "v").join(first.select("net", F.col("part").alias("p"), "since"), "net").where("since < ord").groupBy("v", "ord", "p").agg(F.count(F.lit(1)).alias("n"))
    # Sizes run within ranges of the order; across ranges only their totals for each part are summed up.
    ranged = trace.withColumn("range", F.shiftright("ord", 12))
    totals = ranged.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
    ranges = totals.select("range").distinct().select("range", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("p"))
    earlier = Window.partitionBy("p").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.join(totals.withColumnRenamed("part", "p"), ["range", "p"], "left").select("range", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    every = ranged.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("p"))
    before = Window.partitionBy("range", "p").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    inner = every.withColumn("inner", F.coalesce(F.sum((F.col("part") == F.col("p")).cast("bigint")).over(before), F.lit(0)))
    loads = inner.join(base, ["range", "p"]).select("v", "ord", "part", "p", (F.col("base") + F.col("inner")).alias("size"))
    scored = loads.join(votes, ["v", "ord", "p"], "left").withColumn("score", F.greatest(F.lit(0.0), penalised(F.coalesce("n", F.lit(0)), F.col("size"), limit)))
    best = scored.groupBy("v", "ord", "part").agg(F.max(F.struct("score", (-F.col("size")).alias("s"), (-F.col("p")).alias("p"))).alias("b"))
    return best.select("v", "ord", "part", (-F.col("b.p")).alias("expected")).where("part <> expected")
