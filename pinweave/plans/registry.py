"""All registered queries on the hypergraph operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.model import Hypergraph, header, settled, transpose, validate
from pinweave.operators import coarsen, components, graph, metrics, place, refine, similarity
from pinweave.plans import derive
from pinweave.plans import oracle as o
from pinweave.functions.expressions import renumbered, with_numbers
from pinweave.sources import readers, writers
from pinweave.sources.readers import clean_entries, default_weights
from pinweave.sources.writers import hypergraph_lines
from pinweave.store import folder, settle
from pinweave.streaming import placement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

op, po, hos = derive.orders_parts, derive.parts_orders, derive.orders_suppliers


def register(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# Model and degrees
register("pins_build", f"{o.pins()} SELECT net, v FROM pins", lambda s, d: op(s, d).pins)
register("transpose", f"{o.pins()} SELECT v AS net, net AS v FROM pins", lambda s, d: transpose(op(s, d)).pins)
register("net_degree", f"{o.pins()} SELECT net, count(*) AS degree FROM pins GROUP BY 1", lambda s, d: graph.net_degree(op(s, d)))
register("vertex_degree", f"{o.pins()} SELECT v, count(*) AS degree FROM pins GROUP BY 1", lambda s, d: graph.vertex_degree(op(s, d)))
register("degree_stats", f"{o.pins()} SELECT count(*) AS n, min(d) AS least, max(d) AS most, sum(d)::BIGINT AS pins, avg(d) AS mean FROM (SELECT count(*) AS d FROM pins GROUP BY net)", lambda s, d: graph.degree_stats(graph.net_degree(op(s, d))))
_joined = lambda df: df.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), " "))
register("csr_net_major", f"{o.pins()} SELECT net, string_agg(v, ' ' ORDER BY v) AS members FROM pins GROUP BY 1", lambda s, d: _joined(graph.csr(op(s, d).pins)))
register("csr_vertex_major", f"{o.pins()} SELECT v, string_agg(net, ' ' ORDER BY net) AS members FROM pins GROUP BY 1", lambda s, d: _joined(graph.csr(op(s, d).pins, "v")))
register("csr_offsets", f"{o.pins()} SELECT net, d AS degree, (sum(d) OVER (ORDER BY net) - d)::BIGINT AS start FROM (SELECT net, count(*) AS d FROM pins GROUP BY 1)", lambda s, d: graph.csr_offsets(op(s, d).pins))
register("header_stats", f"{o.pins()} SELECT count(DISTINCT v) AS nov, count(DISTINCT net) AS noe, count(*) AS pins FROM pins", lambda s, d: header(op(s, d)))
register(
    "validate_pins",
    "SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS repeated, count(*) FILTER (l_orderkey IS NULL OR l_partkey IS NULL) AS nulls, count(*) FILTER (l_orderkey < 0 OR l_partkey < 0) AS negative, count(*) FILTER (l_partkey >= 1000) AS beyond FROM lineitem",
    lambda s, d: validate(derive.table(s, d, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_partkey").alias("v")), 1000),
)
register("hypergraph_lines", f"{o.pins()} SELECT net, string_agg(v, ' ' ORDER BY v) AS value FROM pins GROUP BY 1 UNION ALL SELECT -1, '0 ' || count(DISTINCT v) || ' ' || count(DISTINCT net) || ' ' || count(*) FROM pins", lambda s, d: hypergraph_lines(op(s, d)))
register("degenerate_complete", "WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT count(DISTINCT event_type) AS nov, count(DISTINCT user_id) AS noe, count(*) AS pins FROM p", lambda s, d: header(derive.users_events(s, d)))

# Metrics
_m4 = o.state(o.modulo(4), 4)
_np = lambda s, d, k=4: metrics.net_part(op(s, d).pins, derive.modulo(op(s, d), k))


def _msg(s: SparkSession, d: str, k: int) -> DataFrame:
    hg = op(s, d)
    parts = derive.modulo(hg, k)
    return metrics.messages(metrics.net_part(hg.pins, parts), metrics.sourced(hg.nets, parts))


def _report(hg: Hypergraph, k: int) -> DataFrame:
    return metrics.report(hg, derive.modulo(hg, k))


for name, hg_, key in (("metrics_all", op, "op"), ("metrics_dual", po, "po"), ("metrics_suppliers", hos, "os")):
    for k_ in (4, 256) if key == "op" else (8,):
        register(f"{name}_k{k_}", f"{o.state(o.modulo(k_), k_, key)} SELECT {o.METRICS}", lambda s, d, h=hg_, k=k_: _report(h(s, d), k))
register("metrics_skewed_k8", f"{o.state(o.skewed(8), 8)} SELECT {o.METRICS}", lambda s, d: metrics.report(op(s, d), derive.skewed(op(s, d), 8)))
register("net_part", f"{_m4} SELECT net, part, cnt FROM np", _np)
register("lambda", f"{_m4} SELECT net, lam FROM lam", lambda s, d: metrics.connectivity(_np(s, d)))
register("cut_net", f"{_m4} SELECT count(*) AS cn FROM lam WHERE lam > 1", lambda s, d: metrics.cut_net(_np(s, d)))
register("total_volume", f"{_m4} SELECT sum(lam - 1)::BIGINT AS tv FROM lam", lambda s, d: metrics.total_volume(_np(s, d)))
register("total_message", f"{o.state(o.modulo(256), 256)} SELECT count(*) AS tm FROM msg", lambda s, d: metrics.total_message(_msg(s, d, 256)))
register("max_send_message", f"{o.state(o.modulo(256), 256)} SELECT max(sent_messages) AS msm FROM vol", lambda s, d: metrics.max_send_message(_msg(s, d, 256)))
register("max_send_volume", f"{_m4} SELECT max(send) AS msv FROM vol", lambda s, d: metrics.per_part(op(s, d), derive.modulo(op(s, d), 4), 4).agg(F.max("send").alias("msv")))
register("max_send_recv_volume", f"{_m4} SELECT max(send + recv) AS msrv FROM vol", lambda s, d: metrics.per_part(op(s, d), derive.modulo(op(s, d), 4), 4).agg(F.max(F.col("send") + F.col("recv")).alias("msrv")))
register("message_pairs", f"{o.state(o.modulo(64), 64)} SELECT sp, tp, mult FROM msg", lambda s, d: _msg(s, d, 64))
register("per_part_comm", f"{o.state(o.skewed(8), 8)} SELECT part, send, recv, sent_messages, received_messages FROM vol", lambda s, d: metrics.per_part(op(s, d), derive.skewed(op(s, d), 8), 8))
register("part_sizes", f"{o.state(o.skewed(8), 8)} SELECT part, size FROM sizes", lambda s, d: metrics.part_sizes(derive.skewed(op(s, d), 8), 8))
register("imbalance", f"{o.state(o.skewed(8), 8)} SELECT max(size) / avg(size) AS imbalance FROM sizes", lambda s, d: metrics.imbalance(derive.skewed(op(s, d), 8), 8))
register("argmax_parts", f"{o.state(o.skewed(8), 8)} SELECT part, send FROM vol WHERE send = (SELECT max(send) FROM vol)", lambda s, d: _argmax(s, d))
register(
    "improvement_pct",
    f"{o.state(o.skewed(8), 8)}, r AS (SELECT {o.METRICS}) SELECT cn AS cn_before, tv AS tv_before, c2 AS cn_after, t2 AS tv_after, 100 - c2 / cn * 100 AS cn_improvement, 100 - t2 / tv * 100 AS tv_improvement FROM r, "
    f"(SELECT count(*) FILTER (l > 1) AS c2, sum(l - 1)::BIGINT AS t2 FROM (SELECT net, count(DISTINCT {o.modulo(8)}) AS l FROM pins GROUP BY net))",
    lambda s, d: metrics.compare(op(s, d), derive.skewed(op(s, d), 8), derive.modulo(op(s, d), 8)).select(*[f"{m}_{x}" for m in ("cn", "tv") for x in ("before", "after", "improvement")]),
)


def _argmax(s: SparkSession, d: str) -> DataFrame:
    send = metrics.per_part(op(s, d), derive.skewed(op(s, d), 8), 8).select("part", "send")
    return send.join(F.broadcast(send.agg(F.max("send").alias("send"))), "send").select("part", "send")


# Thinning, sources, weights
_thin = lambda s, d: graph.thin(op(s, d), 1.5, 10)
register("thin_nets", f"{o.pins()}, {o.THIN} SELECT net FROM kept", lambda s, d: _thin(s, d).nets.select("net"))
register("thin_renumbered", f"{o.pins()}, {o.THIN} SELECT net, row_number() OVER (ORDER BY net) - 1 AS number FROM kept", lambda s, d: graph.thin_numbers(_thin(s, d)))
register("thin_defaults", f"{o.pins()} SELECT net FROM pins WHERE false", lambda s, d: graph.thin(op(s, d)).nets.select("net"))


def _thin_metrics(s: SparkSession, d: str) -> DataFrame:
    """Placed on the thinned hypergraph, measured on the whole one."""
    hg = op(s, d)
    return metrics.report(hg, settle(place.place(graph.thin(hg, 1.5, 10), graph.id_order(hg), 4, "tv")))


register("thin_metrics_on_full", f"{o.pins()}, {o.THIN}, {o.placed('tv', 4, 'thin')}, parts AS (SELECT v, part FROM a), {o._tables(4)} SELECT {o.METRICS}", _thin_metrics)
register("net_sources", f"{o.pins()} SELECT net, min(v) AS src FROM pins GROUP BY 1", lambda s, d: op(s, d).nets.select("net", "src"))
register("src_target_split", f"{o.pins()} SELECT DISTINCT v, v IN (SELECT min(v) FROM pins GROUP BY net) AS is_source FROM pins", lambda s, d: graph.source_split(op(s, d)))
register("net_weights", f"{o.pins()} SELECT net, CAST(net % 10 AS INTEGER) AS weight, min(v) AS src FROM pins GROUP BY net", lambda s, d: default_weights(op(s, d)))
register(
    "mtx_symmetrize_dedup",
    "WITH e AS (SELECT l_partkey AS i, l_suppkey AS j, l_discount - 0.05 AS w FROM lineitem), m AS (SELECT * FROM e UNION ALL SELECT j, i, w FROM e WHERE i <> j) SELECT i, j, round(sum(abs(w)), 6) AS w FROM m WHERE i <> j AND w <> 0 GROUP BY 1, 2",
    lambda s, d: clean_entries(derive.table(s, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), (F.col("l_discount") - 0.05).alias("w")), True).withColumn("w", F.round("w", 6)),
)

# Breadth-first search
_b = f"{o.pins('po')}, {o.bfs()}"
register("bfs_levels", f"{_b} SELECT v, level FROM b", lambda s, d: graph.bfs(po(s, d)))
register("bfs_farthest", f"{_b} SELECT v, level FROM b ORDER BY level DESC, v LIMIT 1", lambda s, d: graph.farthest(graph.bfs(po(s, d))))
register("bfs_order", f"{_b} SELECT v, row_number() OVER (ORDER BY level, v) - 1 AS ord FROM b", lambda s, d: graph.bfs_order(graph.bfs(po(s, d))))
register(
    "bfs_order_src_target",
    f"{_b}, s AS (SELECT v, level, v IN (SELECT min(v) FROM pins GROUP BY net) AS is_source FROM b) SELECT v, is_source, row_number() OVER (PARTITION BY is_source ORDER BY level, v) - 1 AS ord FROM s",
    lambda s, d: graph.bfs_order_split(graph.bfs(po(s, d)), graph.source_split(po(s, d))),
)
register("bfs_one_level", f"{o.pins('po')} SELECT DISTINCT q.v FROM pins p JOIN pins q USING (net) WHERE p.v = (SELECT min(v) FROM pins) AND q.v <> p.v", lambda s, d: _one_level(po(s, d)))
register(
    "pseudo_peripheral",
    f"{_b}, {o.bfs('SELECT v FROM b ORDER BY level DESC, v LIMIT 1', 'c')}, {o.bfs('SELECT v FROM c ORDER BY level DESC, v LIMIT 1', 'e')} SELECT v, level FROM e",
    lambda s, d: graph.pseudo_peripheral(po(s, d))[1],
)
register("bfs_queue_order", f"{o.pins('po')}, {o.queue_order()} SELECT v, ord FROM q", lambda s, d: graph.bfs_queue_order(po(s, d)))
register("bfs_queue_order_parts", f"{o.pins()}, {o.queue_order('SELECT max(v) FROM pins')} SELECT v, ord FROM q", lambda s, d: graph.bfs_queue_order(op(s, d), op(s, d).vertices.agg(F.max("v")).first()[0]))
register("id_order", f"{o.pins()} SELECT v, row_number() OVER (ORDER BY v) - 1 AS ord FROM (SELECT DISTINCT v FROM pins)", lambda s, d: graph.id_order(op(s, d)))


def _one_level(hg) -> DataFrame:
    start = hg.vertices.agg(F.min("v").alias("v"))
    return graph.top_down(hg.pins, start, start)


# Placement
_place = lambda policy, k: lambda s, d: place.place(op(s, d), graph.id_order(op(s, d)), k, policy)
for policy_ in ("cn", "tv"):
    register(f"place_{policy_}", f"{o.pins()}, {o.placed(policy_, 4)} SELECT v, part FROM a", _place(policy_, 4))
    register(f"place_{policy_}_metrics", f"{o.pins()}, {o.placed(policy_, 4)}, parts AS (SELECT v, part FROM a), {o._tables(4)} SELECT {o.METRICS}", lambda s, d, p=policy_: metrics.report(op(s, d), settle(_place(p, 4)(s, d))))
register("place_tm", f"{o.pins()}, {o.placed_by_messages(8)} SELECT v, part FROM a", _place("tm", 8))
register("place_tm_metrics", f"{o.pins()}, {o.placed_by_messages(8)}, parts AS (SELECT v, part FROM a), {o._tables(8)} SELECT {o.METRICS}", lambda s, d: metrics.report(op(s, d), settle(_place("tm", 8)(s, d))))
register("place_audit", "SELECT NULL::BIGINT AS v, NULL::BIGINT AS ord, NULL::INTEGER AS part, NULL::INTEGER AS expected WHERE false", lambda s, d: place.audit(op(s, d), graph.id_order(op(s, d)), settle(_place("tv", 4)(s, d)), 4))


def _mixed(hg: Hypergraph) -> DataFrame:
    """An order in which sources of nets stand anywhere."""
    own = hg.vertices.select("v", F.struct((F.col("v") * 7919 % 1009).alias("mixed"), "v").alias("place"))
    return renumbered(own, "place", "ord").select("v", "ord")


def _batches(s: SparkSession, d: str, policy: str = "tv", k: int = 4) -> DataFrame:
    hg = settled(op(s, d))
    return place.place_batches(hg, _mixed(hg) if policy == "tm" else graph.id_order(hg), k, policy, batch=-(-hg.vertices.count() // 4))


register("place_batches", f"{o.pins()}, {o.placed_in_batches(4, 4)} SELECT v, part FROM parts", _batches)
register("place_batches_metrics", f"{o.pins()}, {o.placed_in_batches(4, 4)}, {o._tables(4).replace('ks AS', 'ks_ AS', 1)} SELECT {o.METRICS}", lambda s, d: metrics.report(op(s, d), _batches(s, d)))
register("place_batches_cn", f"{o.pins()}, {o.placed_in_batches(4, 4, 'cn')} SELECT v, part FROM parts", lambda s, d: _batches(s, d, "cn"))
register("place_batches_tm", f"{o.pins()}, {o.placed_in_batches(4, 16, 'tm', o.MIXED)} SELECT v, part FROM parts", lambda s, d: _batches(s, d, "tm", 16))


def _stream(s: SparkSession, d: str, policy: str = "tv", k: int = 4) -> DataFrame:
    """Vertices streamed in four files, in the order of their arrival."""
    hg = settled(op(s, d))
    n = hg.vertices.count()
    path = folder(s)
    placement.write_arrivals(settle(place.stream_rows(hg, _mixed(hg) if policy == "tm" else graph.id_order(hg))), path, -(-n // 4))
    return placement.place_stream(path, n, k, s, policy)


register("stream_place_tv", f"{o.pins()}, {o.placed_in_batches(4, 4)} SELECT v, part FROM parts", _stream)
register("stream_place_tm", f"{o.pins()}, {o.placed_in_batches(4, 16, 'tm', o.MIXED)} SELECT v, part FROM parts", lambda s, d: _stream(s, d, "tm", 16))

# Refinement



def _frozen(s: SparkSession, d: str, part: Callable[[Hypergraph, int], DataFrame], k: int) -> refine.Frozen:
    hg = settled(op(s, d))
    return refine.Frozen(hg, settle(part(hg, k)), k)


_RULES = {
    "cn": (derive.skewed, o.skewed, 8, o.CN_MOVES, refine.cn_moves),
    "tv": (derive.skewed, o.skewed, 8, o.tv_moves(False), lambda at: refine.tv_moves(at, guard=False)),
    "tm": (derive.skewed, o.skewed, 256, o.TM_MOVES, refine.tm_moves),
    "msm": (derive.modulo, o.modulo, 256, o.MSM_MOVES, refine.msm_moves),
    "msv": (derive.skewed, o.skewed, 8, o.volume_moves(False), refine.msv_moves),
    "msrv": (derive.skewed, o.skewed, 8, o.volume_moves(True), refine.msrv_moves),
}
for name, (part_, sql_, k_, rule_, moves_) in _RULES.items():
    register(f"refine_{name}_moves", o.moves(sql_(k_), k_, rule_), lambda s, d, p=part_, k=k_, m=moves_: m(_frozen(s, d, p, k)))

    def _after(s: SparkSession, d: str, p=part_, k=k_, m=moves_) -> DataFrame:
        at = _frozen(s, d, p, k)
        chosen = settle(refine.one_each(m(at)))
        return metrics.report(at.hg, settle(refine.applied(at.parts, refine.independent(at.hg, chosen))))

    register(f"refine_{name}_metrics", o.swept(sql_(k_), k_, rule_), _after)

    def _applied(s: SparkSession, d: str, p=part_, k=k_, m=moves_, n=name) -> DataFrame:
        """What one batch of all vertices applies."""
        at = _frozen(s, d, p, k)
        return refine.admitted(at, settle(refine.one_each(m(at))), n)

    register(f"apply_{name}", o.admitted(sql_(k_), k_, rule_, name), _applied)


def _tilted(at: refine.Frozen) -> DataFrame:
    return refine.admitted(at, settle(refine.one_each(refine.tv_moves(at))), "tv")


def _coloured(at: refine.Frozen) -> DataFrame:
    moves = settle(refine.one_each(refine.tv_moves(at)))
    return refine.colour_moves(at.hg, at.parts, moves, F.col("v") * 7919 % 1009)


def _in_batches(s: SparkSession, d: str, part: Callable[[Hypergraph, int], DataFrame], k: int, objective: str) -> DataFrame:
    hg = settled(op(s, d))
    return refine.sweep_batches(hg, settle(part(hg, k)), k, objective, -(-hg.vertices.count() // 4))


for name, (part_, sql_, k_, rule_) in {
    "tv": (derive.tilted, o.tilted, 8, o.tv_moves(True)),
    "tm": (derive.skewed, o.skewed, 64, o.TM_MOVES),
    "msm": (derive.modulo, o.modulo, 256, o.MSM_MOVES),
    "msv": (derive.skewed, o.skewed, 8, o.volume_moves(False)),
    "msrv": (derive.skewed, o.skewed, 8, o.volume_moves(True)),
}.items():
    register(f"refine_batches_{name}", o.refined_in_batches(sql_(k_), k_, rule_, name, 4), lambda s, d, p=part_, k=k_, n=name: _in_batches(s, d, p, k, n))
register("refine_tv_guarded_tilted", o.moves(o.tilted(8), 8, o.tv_moves(True)), lambda s, d: refine.tv_moves(_frozen(s, d, derive.tilted, 8)))
register("apply_tv_tilted", o.admitted(o.tilted(8), 8, o.tv_moves(True), "tv"), lambda s, d: _tilted(_frozen(s, d, derive.tilted, 8)))
register("colour_moves", o.coloured(o.tilted(8), 8, o.tv_moves(True)), lambda s, d: _coloured(_frozen(s, d, derive.tilted, 8)))
register("refine_tv_gain", f"{o.state(o.skewed(8), 8)},\n{o.tv_gains(False)}\nSELECT v, p, q, leave, arrive FROM gains", lambda s, d: refine.tv_gains(_frozen(s, d, derive.skewed, 8), guard=False))
register("refine_tv_guarded", o.moves(o.skewed(8), 8, o.tv_moves(True)), lambda s, d: refine.tv_moves(_frozen(s, d, derive.skewed, 8)))
register("refine_tm_gain", f"{o.state(o.skewed(256), 256)},\n{o._MESSAGE}\nSELECT v, p, part, g AS gain FROM gain", lambda s, d: refine.message_gains(_frozen(s, d, derive.skewed, 256)))
register("refine_two_sweeps", o.swept_twice(o.skewed(8), 8, o.CN_MOVES), lambda s, d: _two_sweeps(settled(op(s, d))))


def _two_sweeps(hg: Hypergraph) -> DataFrame:
    return metrics.report(hg, refine.refine(hg, settle(derive.skewed(hg, 8)), 8, "cn", 2))


# Colours and components
_colour = "colours AS (SELECT DISTINCT v, v % 7 AS colour FROM pins), cnt AS (SELECT net, colour, count(*) AS n FROM pins JOIN colours USING (v) GROUP BY 1, 2), maj AS (SELECT net, colour FROM (SELECT *, row_number() OVER (PARTITION BY net ORDER BY n DESC, colour) AS r FROM cnt) WHERE r = 1)"
_colours = lambda hg: hg.vertices.select("v", F.pmod("v", F.lit(7)).alias("colour"))
register("colour_majority", f"{o.pins()}, {_colour} SELECT net, colour FROM maj", lambda s, d: graph.majority_colour(op(s, d), _colours(op(s, d))))
register("colour_coarse", f"{o.pins()}, {_colour} SELECT v, colour FROM (SELECT v, maj.colour, row_number() OVER (PARTITION BY v ORDER BY net DESC) AS r FROM pins JOIN maj USING (net)) WHERE r = 1", lambda s, d: graph.colour_step(op(s, d), _colours(op(s, d))))
register("colour_histogram", f"{o.pins()}, {_colour} SELECT colour, count(*) AS n FROM colours GROUP BY 1", lambda s, d: _colours(op(s, d)).groupBy("colour").agg(F.count(F.lit(1)).alias("n")))
register("connected_components", f"{o.pins('po')}, {o.components('pins')} SELECT v, component FROM c", lambda s, d: components.connected_components(po(s, d)))
_sparse = lambda s, d: graph.thin(op(s, d), 1e9, 3)
register("components_sparse", f"{o.pins()}, {o.SPARSE}, {o.components('sparse')} SELECT v, component FROM c", lambda s, d: components.connected_components(_sparse(s, d)))
register(
    "largest_component",
    f"{o.pins()}, {o.SPARSE}, {o.components('sparse')} SELECT net, v FROM sparse WHERE v IN (SELECT v FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1))",
    lambda s, d: components.largest_component(_sparse(s, d)).pins,
)

# Coarsening: products by their number modulo 16 become one
_coarse_sql = f"{o.pins()}, cp AS (SELECT net, list(DISTINCT v % 16 ORDER BY v % 16) AS vs FROM pins GROUP BY 1 HAVING count(DISTINCT v % 16) > 1), into_ AS (SELECT net, min(net) OVER (PARTITION BY vs) AS kept, vs FROM cp)"
_groups = lambda hg: hg.vertices.select("v", F.pmod("v", F.lit(16)).alias("coarse"))


def _contracted(s: SparkSession, d: str) -> coarsen.Coarse:
    hg = settled(op(s, d))
    return coarsen.contract(hg, _groups(hg))


register("coarse_pins", f"{_coarse_sql} SELECT net, unnest(vs) AS v FROM into_ WHERE net = kept", lambda s, d: _contracted(s, d).hg.pins)
register("coarse_nets", f"{_coarse_sql}, w AS (SELECT kept AS net, count(*)::INTEGER AS weight FROM into_ GROUP BY 1) SELECT net, weight, (SELECT min(v) FROM pins WHERE pins.net = w.net) % 16 AS src FROM w", lambda s, d: _contracted(s, d).hg.nets)
register("coarse_merged", f"{_coarse_sql} SELECT net, kept AS \"into\" FROM into_", lambda s, d: _contracted(s, d).merged)
register(
    "coarse_cut",
    f"{o.pins()}, lam AS (SELECT net, count(DISTINCT v % 16 % 4) AS lam FROM pins GROUP BY 1) SELECT count(*) FILTER (lam > 1) AS cn, sum(lam - 1)::BIGINT AS tv FROM lam",
    lambda s, d: _coarse_cut(_contracted(s, d).hg),
)
register("coarse_projected", f"{o.pins()} SELECT DISTINCT v, CAST(v % 16 % 4 AS INTEGER) AS part FROM pins", lambda s, d: _projected(s, d))


def _coarse_cut(hg: Hypergraph) -> DataFrame:
    """What the coarse hypergraph says of a partition of the groups; its SQL counts on the whole one."""
    return coarsen.weighted_cut(hg, derive.modulo(hg, 4))


def _projected(s: SparkSession, d: str) -> DataFrame:
    hg = op(s, d)
    return coarsen.projected(_groups(hg), derive.modulo(_contracted(s, d).hg, 4))


# Similarity
register("similarity_signatures", f"{o.pins('po')}, {o.similarity(8, 4)} SELECT v, array_to_string(signature, ' ') AS signature FROM sig", lambda s, d: similarity.signatures(po(s, d), 32).select("v", F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature")))
register("similarity_order", f"{o.pins('po')}, {o.similarity(8, 4)} SELECT v, row_number() OVER (ORDER BY component, signature, v) - 1 AS ord FROM sig JOIN c USING (v)", lambda s, d: similarity.similarity_order(po(s, d), 8, 4))

# Files: each is written to the shared folder and read back
_dense = f"{o.pins()}, {o.DENSE}"


def _numbered(s: SparkSession, d: str) -> Hypergraph:
    """The hypergraph with nets and vertices numbered from 0, as files need them."""
    pins = settle(op(s, d).pins)
    for c in ("net", "v"):
        pins = with_numbers(pins, renumbered(pins.select(c).distinct(), c, "n"), c)
    return settled(Hypergraph.of(pins))


def _hypergraph_file(s: SparkSession, d: str, base: int = 1) -> Hypergraph:
    path = f"{folder(s)}.hg"
    writers.write_hypergraph(_numbered(s, d), path, base)
    return readers.load(s, path)


def _vertex_file(s: SparkSession, d: str) -> Hypergraph:
    path = f"{folder(s)}.hg"
    writers.write_vertex_major(_numbered(s, d), path)
    return readers.load(s, path, "vertex")


def _cached(s: SparkSession, d: str) -> Hypergraph:
    """Read from the cache beside a file that is not there."""
    path = f"{folder(s)}.hg"
    writers.write_cache(op(s, d), readers.cache_path(path))
    return readers.load(s, path)


def _weight_file(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    writers.write_weights(default_weights(_numbered(s, d)), path)
    return readers.read_weights(s, path)


def _part_file(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    writers.write_parts(derive.modulo(_numbered(s, d), 8), path)
    return readers.numbered_lines(s, path).select(F.col("line").alias("v"), F.col("value").cast("int").alias("part"))


def _entries(s: SparkSession, d: str) -> tuple[int, DataFrame]:
    """Parts and suppliers, of one numbering, as a matrix without a diagonal."""
    e = settle(derive.table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct())
    ids = settle(renumbered(e.select("a").union(e.select("b")).distinct(), "a", "n"))
    g = with_numbers(with_numbers(e, ids, "a"), ids.withColumnRenamed("a", "b"), "b").select(F.col("a").alias("i"), F.col("b").alias("j")).where("i <> j")
    return ids.count(), settle(g.select("i", "j", (1 + (F.col("i") + F.col("j")) % 5).cast("double").alias("w")))


def _matrix_file(s: SparkSession, d: str) -> DataFrame:
    path = f"{folder(s)}.mtx"
    writers.write_matrix(*_entries(s, d), path)
    return readers.load_graph(s, path)[2]


def _graph_file(s: SparkSession, d: str, kept: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """A symmetric graph with weights of vertices; of its cache alone with ``kept``."""
    path, (side, entries) = f"{folder(s)}.graph", _entries(s, d)
    entries = clean_entries(entries, symmetric=True)
    weights = s.range(side).select(F.col("id").alias("v"), (1 + F.col("id") % 3).cast("int").alias("weight"))
    if kept:
        writers.write_graph_cache(weights, entries, readers.cache_path(path))
    else:
        writers.write_graph(side, entries, path, weights)
    return readers.load_graph(s, path)


def _array_file(s: SparkSession, d: str, symmetry: str) -> DataFrame:
    """A matrix written as an array and read back; of a symmetric one the lower triangle is written."""
    own = derive.table(s, d, "lineitem").select("l_suppkey", "l_partkey")
    side = own.agg(F.max("l_suppkey")).first()[0] + 1
    entries = settle(own.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % side).alias("j")).distinct().withColumn("w", (1 + (F.col("i") + F.col("j")) % 5).cast("double")))
    path = f"{folder(s)}.mtx"
    writers.write_array(side, entries, path, symmetry)
    return readers.load_graph(s, path)[2]


register("read_matrix_array", f"{o.ARRAY} SELECT i, j, w FROM g WHERE i <> j", lambda s, d: _array_file(s, d, "general"))
_lower = "SELECT i, j, w FROM g WHERE i > j UNION ALL SELECT j, i, w FROM g WHERE i > j"
register("read_matrix_symmetric_array", f"{o.ARRAY} {_lower}", lambda s, d: _array_file(s, d, "symmetric"))
register("read_matrix_skew_array", f"{o.ARRAY} {_lower}", lambda s, d: _array_file(s, d, "skew-symmetric"))
_mirrored = "m AS (SELECT i, j, w FROM g UNION ALL SELECT j, i, w FROM g)"
register("read_net_major", f"{_dense} SELECT net, v FROM numbered", lambda s, d: _hypergraph_file(s, d).pins)
register("read_net_major_zero_based", f"{_dense} SELECT net, v FROM numbered", lambda s, d: _hypergraph_file(s, d, 0).pins)
register("read_vertex_major", f"{_dense} SELECT net, v FROM numbered", lambda s, d: _vertex_file(s, d).pins)
register("read_cache", f"{o.pins()} SELECT net, v FROM pins", lambda s, d: _cached(s, d).pins)
register("read_weights", f"{_dense} SELECT net, CAST(net % 10 AS INTEGER) AS weight, min(v) AS src FROM numbered GROUP BY net", _weight_file)
register("part_vector", f"{_dense} SELECT DISTINCT v, {o.modulo(8)} AS part FROM numbered", _part_file)
register("read_matrix", f"{o.MATRIX} SELECT i, j, w FROM g", _matrix_file)
register("read_graph", f"{o.MATRIX}, {_mirrored} SELECT i, j, sum(w) AS w FROM m GROUP BY 1, 2", lambda s, d: _graph_file(s, d)[2])
register("read_graph_weights", f"{o.MATRIX} SELECT n AS v, CAST(1 + n % 3 AS INTEGER) AS weight FROM i", lambda s, d: _graph_file(s, d)[1])
register("read_graph_cache", f"{o.MATRIX}, {_mirrored} SELECT i, j, sum(w) AS w FROM m GROUP BY 1, 2", lambda s, d: _graph_file(s, d, kept=True)[2])
