"""Refinement: for each objective the moves that its rule accepts on a frozen partition, and sweeps that apply them.

``moves`` are proposals, (v, from_part, to_part, gain), one for each vertex at most. They are joins and aggregates of
``net_part``; no step joins pins with pins. Tables by part or pair of parts have at most K or K * K rows.

``refine`` applies them in one of three modes. A ``sweep`` applies the moves of all vertices, by default only such as share
no net. In ``batch`` mode the vertices are taken in runs of their ids, each with proposals of its own on the partition
that the runs before left, and ``admitted`` looks at sizes and loads again while a run's moves are applied. What a
run changes is kept as signed rows beside the tables of the sweep's start (``State``), which are not written again. In ``colour`` mode the moves are dealt to classes that do not meet on a net.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinweave.functions.expressions import capacity, penalised, renumbered
from pinweave.model import Hypergraph, check_parts
from pinweave.operators.metrics import NAMES, connectivity, messages, net_part, part_sizes, per_part, sourced
from pinweave.ship import ship
from pinweave.store import Rounds, settle, settle_by

OBJECTIVES = NAMES


class Frozen:
    """What the rules read of a partition; tables that several steps need are written once."""

    def __init__(self, hg: Hypergraph, parts: DataFrame, k: int, own: DataFrame | None = None):
        """With ``own`` only these vertices get proposals."""
        check_parts(k)
        self.hg, self.parts, self.k = hg, parts, k
        self.pins = hg.pins
        self.own_pins = hg.pins if own is None else hg.pins.join(own.select("v"), "v", "left_semi")

    @cached_property
    def np(self) -> DataFrame:
        return settle(net_part(self.pins, self.parts))

    @cached_property
    def lam(self) -> DataFrame:
        return connectivity(self.np)

    @cached_property
    def sources(self) -> DataFrame:
        return sourced(self.hg.nets, self.parts)

    @cached_property
    def incidence(self) -> DataFrame:
        """(net, v, p, src, sp): each pin with its own part, and its net's source with that one's."""
        return settle(self.own_pins.join(self.parts.select("v", F.col("part").alias("p")), "v").join(self.sources, "net", "left"))

    @cached_property
    def messages(self) -> DataFrame:
        return settle(messages(self.np, self.sources))

    @cached_property
    def sizes(self) -> DataFrame:
        return settle(part_sizes(self.parts, self.k))

    @cached_property
    def limit(self) -> float:
        return capacity(self.nov, self.k)

    @cached_property
    def nov(self) -> int:
        return self.hg.vertices.count()

    def loads(self, objective: str) -> DataFrame:
        """(part, load): what each part has of that of which the objective is the maximum."""
        load = {"msm": F.col("sent_messages"), "msv": F.col("send"), "msrv": F.col("send") + F.col("recv")}[objective]
        return per_part(self.hg, self.parts, self.k).select("part", load.alias("load"))

    @cached_property
    def alone(self) -> DataFrame:
        """(sp, tp) of the messages that one net alone is sent for: only these can be saved."""
        return settle(self.messages.where("mult = 1").select("sp", "tp"))

    def partners(self, of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For the vertices ``of``: receivers (v, p, r) of the nets that v is the source of, and senders (v, p, s)."""
        inc = self.incidence.join(of.select("v").distinct(), "v", "left_semi")
        own = inc.where("src = v").join(self.np, "net")
        receivers = own.where("part <> p or cnt > 1").select("v", "p", F.col("part").alias("r")).distinct()
        senders = inc.where("src <> v").select("v", "p", F.col("sp").alias("s")).distinct()
        return receivers, senders


def cn_moves(at: Frozen) -> DataFrame:
    """Nets that touch two parts: the fewer pins (on ties those in the higher part) go to the other part.

    A net is left alone if one of these pins is on a net that is not cut. gain is 1 for each net a pin is moved for.
    """
    np, lam = at.np, at.lam
    side = F.struct("cnt", (-F.col("part")).alias("low"))
    two = np.join(lam.where("lam = 2").select("net"), "net", "left_semi").groupBy("net").agg((-F.min(side)["low"]).alias("from_part"), (-F.max(side)["low"]).alias("to_part"))
    minor = at.pins.join(two, "net").join(at.parts, "v").where("part = from_part").select("net", "v", "from_part", "to_part")
    firm = at.pins.join(lam.where("lam = 1").select("net"), "net", "left_semi").select("v").distinct()
    veto = minor.join(firm, "v", "left_semi").select("net").distinct()
    return minor.join(veto, "net", "left_anti").groupBy("v", "from_part", "to_part").agg(F.count(F.lit(1)).alias("gain"))


def candidates(at: Frozen, guard: bool) -> DataFrame:
    """(v, p, q): each vertex's best part by touching nets, its own counted one less; those that stay are left out.

    With ``guard`` a vertex stays if q holds over 1.1 times, or under 0.9 times, nov / K (whole numbers).
    """
    sizes = at.sizes
    touch = at.own_pins.join(at.np.select("net", "part"), "net").groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"))
    own = touch.join(at.parts.select("v", F.col("part").alias("p")), "v").join(F.broadcast(sizes), "part")
    scored = own.withColumn("score", penalised(F.col("n") - (F.col("part") == F.col("p")).cast("bigint"), F.col("size"), at.limit))
    best = scored.groupBy("v", "p").agg(F.max(F.struct("score", (-F.col("size")).alias("size"), (-F.col("part")).alias("part"))).alias("b"))
    least = sizes.agg(F.min(F.struct("size", "part")).alias("least"))
    found = best.crossJoin(F.broadcast(least)).select("v", "p", F.when(F.col("b.score") > 0, -F.col("b.part")).otherwise(F.col("least.part")).alias("q"))
    if guard:
        each = at.nov // at.k
        high, low = int(each + each * 0.1), int(each - each * 0.1)
        found = found.join(F.broadcast(sizes.select(F.col("part").alias("q"), "size")), "q").where(f"size between {low} and {high}").drop("size")
    return found.where("p <> q")


def tv_gains(at: Frozen, guard: bool = True) -> DataFrame:
    """(v, p, q, leave, arrive): nets that v alone holds in p, and nets of v that do not touch q."""
    np = at.np
    pins = at.own_pins.join(settle(candidates(at, guard)), "v")
    there = np.select("net", F.col("part").alias("p"), F.col("cnt").alias("cp"))
    then = np.select("net", F.col("part").alias("q"), F.col("cnt").alias("cq"))
    return pins.join(there, ["net", "p"], "left").join(then, ["net", "q"], "left").groupBy("v", "p", "q").agg(F.sum((F.col("cp") == 1).cast("bigint")).alias("leave"), F.sum(F.col("cq").isNull().cast("bigint")).alias("arrive"))


def tv_moves(at: Frozen, guard: bool = True) -> DataFrame:
    """Moves to the best part that cut no more than they join."""
    return tv_gains(at, guard).where("leave >= arrive").select("v", F.col("p").alias("from_part"), F.col("q").alias("to_part"), (F.col("leave") - F.col("arrive")).alias("gain"))


def message_gains(at: Frozen) -> DataFrame:
    """(v, p, part, gain): messages that ``part`` no longer sends once v has left p.

    Where no message is sent for one net alone, no pin is looked at.
    """
    if at.alone.isEmpty():
        return at.alone.sparkSession.createDataFrame([], "v bigint, p int, part int, gain bigint")
    np, inc, alone = at.np, at.incidence, F.broadcast(at.alone)
    # Both ends of a message that a vertex receives are known before its nets are looked up, of one that it sends the sender.
    met = inc.where("src <> v").join(F.broadcast(at.alone.withColumnRenamed("tp", "p")), ["sp", "p"], "left_semi")
    senders = met.groupBy("v", "p", F.col("sp").alias("s")).agg(F.min("net").alias("net"))
    sent = inc.where("src = v").join(F.broadcast(at.alone.select(F.col("sp").alias("p")).distinct()), "p", "left_semi").join(np, "net").where("part <> p").select("v", "p", F.col("p").alias("sp"), F.col("part").alias("tp")).join(alone, ["sp", "tp"], "left_semi").select("v", "p", F.col("sp").alias("part"))
    last = senders.join(np.where("cnt = 1").select("net", F.col("part").alias("p")), ["net", "p"], "left_semi")
    got = last.select("v", "p", F.col("s").alias("part"))
    return sent.unionByName(got).groupBy("v", "p", "part").agg(F.count(F.lit(1)).alias("gain"))


def message_losses(at: Frozen, targets: DataFrame) -> DataFrame:
    """(v, q, part, loss): messages that ``part`` newly sends once v is in q, for the targets (v, q).

    Partners and targets meet on v only, and both are parts: at most K * K rows a vertex, of those with a gain.
    """
    msg = F.broadcast(at.messages.select("sp", "tp"))
    receivers, senders = at.partners(targets)
    to = targets.join(receivers, "v").where("r <> q").select("v", "q", F.col("q").alias("sp"), F.col("r").alias("tp")).join(msg, ["sp", "tp"], "left_anti")
    by = targets.join(senders, "v").where("s <> q").select("v", "q", F.col("s").alias("sp"), F.col("q").alias("tp")).join(msg, ["sp", "tp"], "left_anti")
    return to.unionByName(by).groupBy("v", "q", F.col("sp").alias("part")).agg(F.count(F.lit(1)).alias("loss"))


#: Parts up to which the messages between all of them are broadcast, as a table of K * K bytes (16 MB).
MOST_PARTS = 4096


def tm_moves(at: Frozen) -> DataFrame:
    """The move to a part with room that saves most messages, the lowest part on ties.

    A vertex is one row with its receivers and senders, K values at most each. What it would send or get anew in each
    part is a product of these with the table of the pairs of parts that exchange nothing yet.
    """
    if at.k > MOST_PARTS:
        raise ValueError(f"message moves are for up to {MOST_PARTS} parts, not {at.k}")
    gains = settle(message_gains(at).groupBy("v", "p").agg(F.sum("gain").alias("saved")))
    if gains.isEmpty():
        return _no_moves(gains)
    receivers, senders = at.partners(gains)
    receivers = receivers.groupBy("v").agg(F.collect_list("r").alias("receivers"))
    senders = senders.groupBy("v").agg(F.collect_list("s").alias("senders"))
    rows = gains.join(receivers, "v", "left").join(senders, "v", "left")
    silent = np.ones((at.k, at.k), dtype=bool)
    np.fill_diagonal(silent, False)
    for r in at.messages.groupBy("sp").agg(F.collect_set("tp").alias("to")).toLocalIterator():
        silent[r["sp"], r["to"]] = False
    sizes = np.zeros(at.k, np.int64)
    for part, size in at.sizes.collect():
        sizes[part] = size
    sent = at.hg.pins.sparkSession.sparkContext.broadcast((silent, sizes < at.limit))
    ship(at.hg.pins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet, able = sent.value[0].astype(np.float32), sent.value[1]

        def partners(column: pa.Array) -> np.ndarray:
            """A row of zeros and ones for each vertex."""
            out = np.zeros((len(column), len(quiet)), np.float32)
            row = np.repeat(np.arange(len(column)), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            out[row, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = 1
            return out

        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):
            own = batch.column("p").to_numpy().astype(np.int64)
            lost = partners(batch.column("receivers")) @ quiet.T + partners(batch.column("senders")) @ quiet
            gain = batch.column("saved").to_numpy()[:, None] - lost.astype(np.int64)
            gain[:, ~able] = 0
            gain[np.arange(len(own)), own] = 0
            to = gain.argmax(axis=1)
            best = gain[np.arange(len(own)), to]
            kept = best > 0
            yield pa.RecordBatch.from_arrays([batch.column("v").filter(pa.array(kept)), pa.array(own[kept].astype(np.int32)), pa.array(to[kept].astype(np.int32)), pa.array(best[kept])], ["v", "from_part", "to_part", "gain"])

    return rows.select("v", "p", "saved", "receivers", "senders").mapInArrow(run, "v bigint, from_part int, to_part int, gain bigint")


def _no_moves(of: DataFrame) -> DataFrame:
    return of.sparkSession.createDataFrame([], "v bigint, from_part int, to_part int, gain bigint")


def _other_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(v, p, q) for each vertex and every part but its own; the parts are K at most."""
    return found.select("v", "p").distinct().crossJoin(F.broadcast(parts.select(F.col("part").alias("q")))).where("p <> q")


def _best(net: DataFrame) -> DataFrame:
    best = net.groupBy("v", "p").agg(F.max(F.struct("gain", (-F.col("q")).alias("low"))).alias("b"))
    return best.select("v", F.col("p").alias("from_part"), (-F.col("b.low")).cast("int").alias("to_part"), F.col("b.gain").alias("gain"))


def message_changes(at: Frozen, to: DataFrame) -> DataFrame:
    """(v, p, q, part, change): messages that a part sends more once v has gone from p to q, for the rows (v, p, q)."""
    fewer = to.join(message_gains(at).select("v", "part", "gain"), "v").select("v", "p", "q", "part", (-F.col("gain")).alias("change"))
    more = to.join(message_losses(at, to.select("v", "q")), ["v", "q"]).select("v", "p", "q", "part", F.col("loss").alias("change"))
    return fewer.unionByName(more).groupBy("v", "p", "q", "part").agg(F.sum("change").alias("change"))


def msm_moves(at: Frozen) -> DataFrame:
    """The move by which every part with most messages sends fewer and no other comes up to them; sizes do not count."""
    load = settle(at.loads("msm"))
    own = load.crossJoin(F.broadcast(load.agg(F.max("load").alias("top"))))
    # A vertex must take a message off every part at the top, so the others need no targets.
    at_top = own.where("load = top").select("part")
    n_top = F.broadcast(at_top.agg(F.count(F.lit(1)).alias("n_top")))
    gains = settle(message_gains(at))
    if gains.isEmpty():
        return _no_moves(gains)
    able = gains.join(F.broadcast(at_top), "part", "left_semi").groupBy("v", "p").agg(F.count(F.lit(1)).alias("n")).crossJoin(n_top).where("n = n_top").select("v", "p")
    change = message_changes(at, settle(_other_parts(able, load))).join(F.broadcast(own), "part")
    judged = change.groupBy("v", "p", "q").agg(
        F.sum(((F.col("load") == F.col("top")) & (F.col("change") < 0)).cast("bigint")).alias("better"),
        F.sum(F.when(F.col("load") == F.col("top"), -F.col("change")).otherwise(0)).alias("gain"),
        F.max((F.col("load") < F.col("top")) & (F.col("load") + F.col("change") >= F.col("top"))).alias("spoilt"),
    )
    return _best(judged.crossJoin(n_top).where("better = n_top and not spoilt"))


def volume_changes(at: Frozen, found: DataFrame, received: bool) -> DataFrame:
    """(v, p, q, part, change): what the rule reckons that a part's volume grows by if v goes from p to q."""
    np = at.np
    pins = at.incidence.drop("p").join(found, "v").join(at.lam, "net")
    pins = pins.join(np.select("net", F.col("part").alias("p"), F.col("cnt").alias("cp")), ["net", "p"], "left").join(np.select("net", F.col("part").alias("q"), F.lit(1).alias("has")), ["net", "q"], "left")
    leaves, joins = (F.col("cp") == 1).cast("bigint"), F.col("has").isNull().cast("bigint")
    change = lambda part, by: F.struct(F.col(part).alias("part"), by.cast("bigint").alias("change"))
    own = [change("p", 1 - F.col("lam")), change("q", F.col("lam") - 1 - leaves + joins)]
    other = [change("sp", joins - leaves)]
    if received:
        other += [change("p", -leaves), change("q", joins)]
    # One pass over the joins, whatever a pin changes.
    every = pins.select("v", "p", "q", F.explode(F.when(F.col("src") == F.col("v"), F.array(*own)).otherwise(F.array(*other))).alias("c"))
    return every.select("v", "p", "q", "c.part", "c.change").where("part is not null").groupBy("v", "p", "q", "part").agg(F.sum("change").alias("change"))


def _volume_moves(at: Frozen, received: bool) -> DataFrame:
    found = settle(candidates(at, guard=False))
    load = settle(at.loads("msrv" if received else "msv"))
    own = load.crossJoin(F.broadcast(load.agg(F.max("load").alias("top"))))
    n_top = F.broadcast(own.where("load = top").agg(F.count(F.lit(1)).alias("n_top")))
    change = volume_changes(at, found, received).join(F.broadcast(own), "part")
    at_top = F.col("load") == F.col("top")
    judged = change.groupBy("v", "p", "q").agg(
        F.sum((at_top & (F.col("change") < 0)).cast("bigint")).alias("better"),
        F.max((at_top & (F.col("change") > 0)) | (~at_top & (F.col("load") + F.col("change") >= F.col("top")))).alias("spoilt"),
        F.sum(F.when(at_top, -F.col("change")).otherwise(0)).alias("gain"),
    )
    kept = judged.crossJoin(n_top).where("not spoilt and better = n_top" if received else "not spoilt")
    return kept.select("v", F.col("p").alias("from_part"), F.col("q").alias("to_part"), "gain")


def msv_moves(at: Frozen) -> DataFrame:
    """Moves to the best part after which no part with most sent volume has more, and no other comes up to them."""
    return _volume_moves(at, received=False)


def msrv_moves(at: Frozen) -> DataFrame:
    """As for sent volume, with what is received, and every part with most must have less."""
    return _volume_moves(at, received=True)


RULES = {"cn": cn_moves, "tv": tv_moves, "tm": tm_moves, "msm": msm_moves, "msv": msv_moves, "msrv": msrv_moves}


def one_each(moves: DataFrame) -> DataFrame:
    """One move a vertex: the largest gain, then the lowest target."""
    best = moves.groupBy("v").agg(F.max(F.struct("gain", (-F.col("to_part")).alias("low"), "from_part")).alias("b"))
    return best.select("v", F.col("b.from_part").alias("from_part"), (-F.col("b.low")).cast("int").alias("to_part"), F.col("b.gain").alias("gain"))


def independent(hg: Hypergraph, moves: DataFrame) -> DataFrame:
    """Moves of vertices no two of which share a net: those with the largest gain, then lowest id, on all their nets."""
    key = F.struct("gain", (-F.col("v")).alias("low"))
    pins = hg.pins.join(moves, "v")
    best = pins.groupBy("net").agg(F.max(key).alias("best"))
    lost = pins.join(best, "net").where(key != F.col("best")).select("v").distinct()
    return moves.join(lost, "v", "left_anti")


def applied(parts: DataFrame, moves: DataFrame) -> DataFrame:
    return parts.join(moves.select("v", "to_part"), "v", "left").select("v", F.coalesce("to_part", "part").cast("int").alias("part"))


def admitted(at: Frozen, moves: DataFrame, objective: str) -> DataFrame:
    """Those of a batch's moves, one a vertex, that are applied; moves take effect in the order of the vertices.

    * ``cn``, ``tv``, ``tm`` look at sizes. All ``cn`` moves apply. A part takes ``tm`` moves while it has under 1.02
      times the capacity; the places that moves free count from the next batch on. The first ``tv`` move to a part that
      then has over 1.1 times nov / K ends the batch.
    * ``msm``, ``msv``, ``msrv`` look at the loads of all parts, which each move changes by what it was proposed for. The
      move after which a part has the maximum that did not have it before the batch is the batch's last.
    """
    if objective == "cn":
        return moves
    if objective == "tm":
        arrived = F.row_number().over(Window.partitionBy("to_part").orderBy("v")) - 1
        taken = moves.join(F.broadcast(at.sizes), F.col("part") == F.col("to_part")).withColumn("arrived", arrived)
        return taken.where(F.col("size") + F.col("arrived") < 1.02 * at.limit).select(moves.columns)
    if objective == "tv":
        # Each move is a row at its target, where it asks, and one at its origin; both count from the next row on.
        to = moves.select("v", F.col("to_part").alias("part"), F.lit(1).alias("step"), F.lit(True).alias("asks"))
        out = moves.select("v", F.col("from_part").alias("part"), F.lit(-1).alias("step"), F.lit(False).alias("asks"))
        before = F.coalesce(F.sum("step").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        full = to.unionByName(out).withColumn("before", before).join(F.broadcast(at.sizes), "part").where(F.col("asks") & (F.col("size") + F.col("before") > 1.1 * at.nov / at.k))
        return _until(moves, full, inclusive=False)
    chosen = moves.select("v", F.col("from_part").alias("p"), F.col("to_part").alias("q"))
    changes = message_changes(at, chosen) if objective == "msm" else volume_changes(at, chosen, objective == "msrv")
    load = settle(at.loads(objective))
    top = F.broadcast(load.agg(F.max("load").alias("start")))
    each = moves.select("v").crossJoin(F.broadcast(load.crossJoin(top))).join(changes.select("v", "part", "change"), ["v", "part"], "left")
    now = F.col("load") + F.sum(F.coalesce("change", F.lit(0))).over(Window.partitionBy("part").orderBy("v"))
    after = each.withColumn("now", now).groupBy("v").agg(F.max("now").alias("top"), F.max(F.when(F.col("load") < F.col("start"), F.col("now"))).alias("other"))
    return _until(moves, after.where("other = top"), inclusive=True)


def _until(moves: DataFrame, ends: DataFrame, inclusive: bool) -> DataFrame:
    """The moves before the first vertex of ``ends``, all if there is none."""
    last = F.broadcast(ends.agg(F.min("v").alias("last")))
    before = F.col("v") <= F.col("last") if inclusive else F.col("v") < F.col("last")
    return moves.crossJoin(last).where(F.col("last").isNull() | before).select(moves.columns)


def sweep(hg: Hypergraph, parts: DataFrame, k: int, objective: str, monotone: bool = True) -> DataFrame:
    """The parts after one sweep. With ``monotone`` only moves apply that do not meet on a net."""
    moves = settle(one_each(RULES[objective](Frozen(hg, parts, k))))
    return applied(parts, independent(hg, moves) if monotone else moves)


class Levels:
    """A table that grows batch by batch, two tables of one rank merged into one of the next by ``merge``.

    Every row is so written as often as the logarithm of the batches.
    """

    def __init__(self, empty: DataFrame, merge: Callable[[DataFrame], DataFrame]):
        self.empty, self.merge, self.tables = empty, merge, []

    def table(self) -> DataFrame:
        return self.merge(reduce(DataFrame.unionByName, [t for _, t in self.tables], self.empty))

    def add(self, new: DataFrame) -> None:
        """Takes a settled table."""
        self.tables.append((0, new))
        while len(self.tables) > 1 and self.tables[-1][0] == self.tables[-2][0]:
            (rank, a), (_, b) = self.tables.pop(), self.tables.pop()
            self.tables.append((rank + 1, settle(self.merge(a.unionByName(b)))))


def _summed(*keys: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """Signed rows summed up; what has come to nothing is left out."""
    return lambda df: df.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


class Batch(Frozen):
    """What the rules read of the vertices of one batch: their own nets as they are now, and totals of all parts."""

    def __init__(self, state: State, number: int):
        self.hg, self.k, self.state = state.hg, state.k, state
        self.parts = state.vertices.where(F.col("b") == number).select("v", "part")
        self.number, self.since, self.moved = number, state.changes.table(), state.moved.table()
        self.messages = settle(state.messages.table())
        self.sizes = state.totals(state.part_size, "size")
        self.nov = state.nov

    @cached_property
    def pins(self) -> DataFrame:
        return self.state.pins.where(F.col("b") == self.number).select("net", "v")

    @property
    def own_pins(self) -> DataFrame:
        return self.pins

    @cached_property
    def np(self) -> DataFrame:
        base = self.state.net_part.where(F.col("b") == self.number).select("net", "part", "cnt")
        since = self.since.join(self.pins.select("net").distinct(), "net", "left_semi")
        return settle(_summed("net", "part", value="cnt")(base.unionByName(since)))

    @cached_property
    def sources(self) -> DataFrame:
        moved = self.moved.select(F.col("v").alias("src"), F.col("part").alias("now"))
        source = self.state.sources.where(F.col("b") == self.number).join(moved, "src", "left")
        return settle(source.select("net", "src", F.coalesce("now", "sp").alias("sp"), "is_pin").where("sp is not null"))

    def loads(self, objective: str) -> DataFrame:
        all_parts = self.state.totals([0] * self.k, "load").drop("load")
        sent = self.messages.groupBy(F.col("sp").alias("part")).agg(F.count(F.lit(1)).alias("load"))
        if objective == "msm":
            return all_parts.join(sent, "part", "left").select("part", F.coalesce("load", F.lit(0)).alias("load"))
        send = self.state.totals(self.state.send, "send")
        if objective == "msv":
            return send.withColumnRenamed("send", "load")
        received = self.messages.groupBy(F.col("tp").alias("part")).agg(F.sum("mult").alias("recv"))
        return send.join(received, "part", "left").select("part", (F.col("send") + F.coalesce("recv", F.lit(0))).alias("load"))


class State:
    """A partition under refinement, kept as it was at the start of a sweep and what has changed since.

    The pins, the nets' parts and their sources are laid out once by the batch that needs them, so that a batch reads only
    its own, and not before one needs any: a rule that finds nothing to gain in the messages looks at no pin. Moves are a log; the pins that they take from a part and bring to another are signed rows, summed up where
    they are read, and so are the messages between parts. Sizes and sent volumes are K numbers.
    """

    def __init__(self, hg: Hypergraph, parts: DataFrame, k: int, batches: DataFrame):
        """``batches`` is (v, b): the batch of each vertex that may move."""
        spark = hg.pins.sparkSession
        self.hg, self.k, self.spark = hg, k, spark
        self.vertices = settle_by(batches.select("v", "b").join(parts, "v", "left"), "b")
        self.nov = hg.vertices.count()
        self.start = start = settle(net_part(hg.pins, parts))
        is_pin = hg.pins.join(hg.nets.select("net", F.col("src").alias("v")), ["net", "v"], "left_semi").select("net", F.lit(True).alias("is_pin"))
        self.start_sources = sources = settle(sourced(hg.nets, parts).join(is_pin, "net", "left").select("net", "src", "sp", F.coalesce("is_pin", F.lit(False)).alias("is_pin")))
        frame = spark.createDataFrame
        self.changes = Levels(frame([], "net bigint, part int, cnt bigint"), _summed("net", "part", value="cnt"))
        self.messages = Levels(frame([], "sp int, tp int, mult bigint"), _summed("sp", "tp", value="mult"))
        self.moved = Levels(frame([], "v bigint, part int"), lambda df: df)
        self.messages.add(settle(messages(start, sources)))
        self.part_size = self._numbers(part_sizes(parts, k), "size")
        self.send = self._numbers(self._volume(start, sources), "send")

    @cached_property
    def pins(self) -> DataFrame:
        return settle_by(self.hg.pins.join(self.vertices.select("v", "b"), "v"), "b")

    @cached_property
    def net_part(self) -> DataFrame:
        return settle_by(self.pins.select("b", "net").distinct().join(self.start, "net"), "b")

    @cached_property
    def sources(self) -> DataFrame:
        return settle_by(self.pins.select("b", "net").distinct().join(self.start_sources, "net"), "b")

    def _numbers(self, df: DataFrame, value: str) -> list[int]:
        out = [0] * self.k
        for r in df.collect():  # K rows at most
            out[r["part"]] = r[value]
        return out

    def totals(self, values: list[int], name: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(values)), f"part int, {name} bigint")

    @staticmethod
    def _volume(np: DataFrame, sources: DataFrame) -> DataFrame:
        return connectivity(np).join(sources.where("is_pin"), "net").groupBy(F.col("sp").alias("part")).agg(F.sum(F.col("lam") - 1).alias("send"))

    def apply(self, at: Batch, moves: DataFrame) -> None:
        """Takes in the moves of a batch; only the nets of moved vertices are looked at."""
        step = at.pins.join(moves, "v").select("net", F.explode(F.array(F.struct(F.col("from_part").alias("part"), F.lit(-1).cast("bigint").alias("cnt")), F.struct(F.col("to_part").alias("part"), F.lit(1).cast("bigint").alias("cnt")))).alias("s")).select("net", "s.part", "s.cnt")
        change = settle(_summed("net", "part", value="cnt")(step))
        touched = at.pins.join(moves, "v", "left_semi").select("net").distinct()
        before = settle(at.np.join(touched, "net", "left_semi"))
        after = settle(_summed("net", "part", value="cnt")(before.unionByName(change)))
        held = at.sources.join(touched, "net", "left_semi")
        then = settle(held.join(moves.select(F.col("v").alias("src"), F.col("to_part").alias("now")), "src", "left").select("net", "src", F.coalesce("now", "sp").alias("sp"), "is_pin"))
        gone = messages(before, held).select("sp", "tp", (-F.col("mult")).alias("mult"))
        self.messages.add(settle(_summed("sp", "tp", value="mult")(gone.unionByName(messages(after, then)))))
        for sign, found in ((-1, self._volume(before, held)), (1, self._volume(after, then))):
            self.send = [a + sign * b for a, b in zip(self.send, self._numbers(found, "send"), strict=True)]
        for sign, side in ((-1, "from_part"), (1, "to_part")):
            self.part_size = [a + sign * b for a, b in zip(self.part_size, self._numbers(moves.groupBy(F.col(side).alias("part")).agg(F.count(F.lit(1)).alias("n")), "n"), strict=True)]
        self.changes.add(change)
        self.moved.add(settle(moves.select("v", F.col("to_part").alias("part"))))


def sweep_batches(hg: Hypergraph, parts: DataFrame, k: int, objective: str, batch: int) -> DataFrame:
    """The parts after one sweep in batches of so many vertices by id, each on the partition that those before left.

    A batch reads its own nets and the changes since the sweep began, and writes no more than it changes. Nets of the
    ``cn`` rule move as a whole, so its batch is the sweep, whatever ``batch`` says.
    """
    if batch < 1:
        raise ValueError(f"a batch has a vertex at least, not {batch}")
    if objective == "cn":
        at = Frozen(hg, parts, k)
        return settle(applied(parts, admitted(at, settle(one_each(cn_moves(at))), objective)))
    order = renumbered(hg.vertices, "v", "ord").select("v", F.floor(F.col("ord") / batch).cast("int").alias("b"))
    state = State(hg, parts, k, order)
    for number in range(-(-state.nov // batch)):
        at = Batch(state, number)
        proposed = settle(one_each(RULES[objective](at)))
        if proposed.isEmpty():
            continue
        moves = settle(admitted(at, proposed, objective))
        if not moves.isEmpty():
            state.apply(at, moves)
    return settle(applied(parts, state.moved.table().withColumnRenamed("part", "to_part")))


def conflicts(hg: Hypergraph, parts: DataFrame, moves: DataFrame) -> DataFrame:
    """(net, v): the moving vertices of each net of which two at once could change its parts otherwise than one by one.

    A net's parts are those with pins of it. A part that keeps a pin when all that want to have left stays one whoever
    moves, and so whoever comes to it changes nothing. Only moves from or to other parts meet, so most of the vertices of
    a net with very many pins do not.
    """
    own = hg.pins.join(moves.select("v", "from_part", "to_part"), "v")
    nets = own.select("net").distinct()
    held = net_part(hg.pins.join(nets, "net", "left_semi"), parts)
    leaving = own.groupBy("net", F.col("from_part").alias("part")).agg(F.count(F.lit(1)).alias("out"))
    firm = held.join(leaving, ["net", "part"], "left").where(F.col("cnt") > F.coalesce("out", F.lit(0))).select("net", "part")
    for side in ("from_part", "to_part"):
        own = own.join(firm.select("net", F.col("part").alias(side), F.lit(True).alias(f"firm_{side}")), ["net", side], "left")
    return own.where("firm_from_part is null or firm_to_part is null").select("net", "v")


def colour_moves(hg: Hypergraph, parts: DataFrame, moves: DataFrame, priority: Column | None = None) -> DataFrame:
    """(v, colour): moving vertices of one colour do not meet on a net (see ``conflicts``).

    In each round the vertices that come first, by priority (a hash of the id by default) and then id, on all nets where
    they meet others take the least colour that these nets have not seen. The rounds grow with the longest chain of falling
    priorities. The result is that of colouring one by one in this order.
    """
    rounds = Rounds(hg.pins.sparkSession)
    first = F.struct((F.xxhash64("v") if priority is None else priority).alias("p"), "v")
    met = settle(conflicts(hg, parts, moves).withColumn("first", first))
    left, used, done = met, None, [moves.select("v").join(met.select("v").distinct(), "v", "left_anti").select("v", F.lit(0).alias("colour"))]
    while not left.isEmpty():
        best = left.groupBy("net").agg(F.max("first").alias("best"))
        later = left.join(best, "net").where("first <> best").select("v").distinct()
        now = left.join(later, "v", "left_anti").select("net", "v")
        if used is None:
            taken = now.groupBy("v").agg(F.array().cast("array<int>").alias("seen"))
        else:
            taken = now.join(used, "net", "left").groupBy("v").agg(F.collect_set("colour").alias("seen"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("seen")), "seen"))
        done.append(settle(taken.select("v", free.alias("colour"))))
        new = now.join(done[-1], "v").select("net", "colour")
        used = rounds.settle("used", (new if used is None else used.unionByName(new)).distinct())
        left = rounds.settle("left", left.join(done[-1], "v", "left_anti"))
    return reduce(DataFrame.unionByName, done)


def exact_changes(at: Batch, moves: DataFrame) -> DataFrame:
    """The moves with ``tv_gain`` and ``cn_gain``: by how much each, applied alone, lowers the two objectives."""
    there = at.np.select("net", F.col("part").alias("from_part"), F.col("cnt").alias("cp"))
    then = at.np.select("net", F.col("part").alias("to_part"), F.lit(1).alias("has"))
    own = at.pins.join(moves.select("v", "from_part", "to_part"), "v").join(at.lam, "net").join(there, ["net", "from_part"], "left").join(then, ["net", "to_part"], "left")
    less = F.when(F.col("cp") == 1, 1).otherwise(0) - F.when(F.col("has").isNull(), 1).otherwise(0)
    cut = (F.col("lam") > 1).cast("bigint") - (F.col("lam") - less > 1).cast("bigint")
    gains = own.groupBy("v").agg(F.sum(less).cast("bigint").alias("tv_gain"), F.sum(cut).alias("cn_gain"))
    return moves.join(gains, "v")


def sweep_coloured(hg: Hypergraph, parts: DataFrame, k: int, objective: str = "tv", priority: Column | None = None) -> tuple[DataFrame, list[dict[str, int]]]:
    """The parts after a sweep whose moves see all those of the colours before theirs, and what each colour gained.

    The proposals of the sweep's start are coloured; colour by colour each is looked at again on the partition as it then
    is and applied if it does not worsen the objective, ``tv`` or ``cn``, and, for ``tv``, if ``admitted`` lets it. As
    moves of one colour do not meet, their exact changes add up: ``tv_gain`` and ``cn_gain`` are the real ones.
    """
    if objective not in ("cn", "tv"):
        raise ValueError(f"coloured sweeps are for cn and tv, not {objective!r}")
    moves = settle(one_each(RULES[objective](Frozen(hg, parts, k))))
    colours = settle(colour_moves(hg, parts, moves, priority))
    state = State(hg, parts, k, colours.withColumnRenamed("colour", "b"))
    gained = []
    for colour in [r["colour"] for r in colours.select("colour").distinct().orderBy("colour").collect()]:
        at = Batch(state, colour)
        judged = settle(exact_changes(at, moves.join(at.parts.select("v"), "v", "left_semi")).where(F.col(f"{objective}_gain") >= 0))
        kept = settle(admitted(at, judged, objective))
        total = kept.agg(F.count(F.lit(1)).alias("moves"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tv_gain", "cn_gain")]).first().asDict()
        gained.append({"colour": colour, **total})
        if total["moves"]:
            state.apply(at, kept)
    return settle(applied(parts, state.moved.table().withColumnRenamed("part", "to_part"))), gained


def refine(hg: Hypergraph, parts: DataFrame, k: int, objective: str, sweeps: int = 1, monotone: bool = True, mode: str = "sweep", batch: int = 100_000) -> DataFrame:
    """The parts after a fixed number of sweeps, each written to the shared folder.

    In ``batch`` mode a batch of one vertex lets every move see all the moves before it; in ``colour`` mode, for ``cn`` and
    ``tv``, moves see those of all colours before theirs, at the cost of a round for each colour.
    """
    check_parts(k)
    if objective not in RULES:
        raise ValueError(f"no objective {objective!r}")
    if mode not in ("sweep", "batch", "colour"):
        raise ValueError(f"no mode {mode!r}")
    for _ in range(sweeps):
        if mode == "colour":
            parts = sweep_coloured(hg, parts, k, objective)[0]
        else:
            parts = sweep_batches(hg, parts, k, objective, batch) if mode == "batch" else settle(sweep(hg, parts, k, objective, monotone))
    return parts
