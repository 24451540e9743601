"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from pinweave.operators.similarity import PRIME, coefficients

PINS = {
    "op": "SELECT DISTINCT l_orderkey AS net, l_partkey AS v FROM lineitem",
    "po": "SELECT DISTINCT l_partkey AS net, l_orderkey AS v FROM lineitem",
    "os": "SELECT DISTINCT l_orderkey AS net, l_suppkey AS v FROM lineitem",
}


def modulo(k: int) -> str:
    return f"CAST(v % {k} AS INTEGER)"


def skewed(k: int) -> str:
    return f"CAST(CASE WHEN v % 5 = 0 THEN 0 ELSE v % {k} END AS INTEGER)"


def tilted(k: int = 8) -> str:
    m = "(v * 7919 % 1000)"
    return f"CAST(CASE WHEN {m} < 114 THEN 1 WHEN {m} < 284 THEN 0 ELSE 2 + {m} % 6 END AS INTEGER)"


def pins(name: str = "op") -> str:
    return f"WITH RECURSIVE pins AS ({PINS[name]})"


def state(part: str, k: int, name: str = "op") -> str:
    """pins, parts, src, np, lam, sources, msg, sizes and cap."""
    return f"""{pins(name)},
parts AS (SELECT DISTINCT v, {part} AS part FROM pins), {_tables(k)}"""


def _tables(k: int) -> str:
    return f"""src AS (SELECT net, min(v) AS src FROM pins GROUP BY net),
np AS (SELECT net, part, count(*) AS cnt FROM pins JOIN parts USING (v) GROUP BY 1, 2),
lam AS (SELECT net, count(*) AS lam FROM np GROUP BY 1),
sources AS (SELECT net, src, part AS sp FROM src JOIN parts ON v = src),
msg AS (SELECT sp, part AS tp, count(*) AS mult FROM np JOIN sources USING (net) WHERE sp <> part GROUP BY 1, 2),
ks AS (SELECT unnest(range({k}))::INTEGER AS part),
sizes AS (SELECT ks.part, count(v) AS size FROM ks LEFT JOIN parts USING (part) GROUP BY 1),
cap AS (SELECT CAST(count(*) // {k} AS DOUBLE) * 1.05 AS cap, count(*) // {k} AS each FROM parts),
vol AS (SELECT ks.part, coalesce(s, 0)::BIGINT AS send, coalesce(r, 0)::BIGINT AS recv, coalesce(sm, 0)::BIGINT AS sent_messages, coalesce(rm, 0)::BIGINT AS received_messages FROM ks
  LEFT JOIN (SELECT sp AS part, sum(lam - 1) AS s FROM sources JOIN lam USING (net) GROUP BY 1) USING (part)
  LEFT JOIN (SELECT sp AS part, count(*) AS sm FROM msg GROUP BY 1) USING (part)
  LEFT JOIN (SELECT tp AS part, sum(mult) AS r, count(*) AS rm FROM msg GROUP BY 1) USING (part))"""


METRICS = """(SELECT count(*) FROM lam WHERE lam > 1) AS cn, (SELECT sum(lam - 1)::BIGINT FROM lam) AS tv, (SELECT count(*) FROM msg) AS tm,
(SELECT max(sent_messages) FROM vol) AS msm, (SELECT max(send) FROM vol) AS msv, (SELECT max(send + recv) FROM vol) AS msrv"""

#: Rules of refinement on a state; each ends in a table of moves.
CN_MOVES = """side AS (SELECT net, part, row_number() OVER (PARTITION BY net ORDER BY cnt, part DESC) AS r FROM np WHERE net IN (SELECT net FROM lam WHERE lam = 2)),
minor AS (SELECT p.net, p.v, a.part AS from_part, b.part AS to_part FROM side a JOIN side b ON a.net = b.net AND a.r = 1 AND b.r = 2 JOIN pins p ON p.net = a.net JOIN parts q ON q.v = p.v AND q.part = a.part),
firm AS (SELECT DISTINCT v FROM pins WHERE net IN (SELECT net FROM lam WHERE lam = 1)),
moves AS (SELECT v, from_part, to_part, count(*) AS gain FROM minor WHERE net NOT IN (SELECT net FROM minor WHERE v IN (SELECT v FROM firm)) GROUP BY 1, 2, 3)"""


def _candidates(guard: bool) -> str:
    rule = " AND size BETWEEN CAST(floor(each - each * 0.1) AS BIGINT) AND CAST(floor(each + each * 0.1) AS BIGINT)" if guard else ""
    return f"""touch AS (SELECT p.v, n.part, count(*) AS n FROM pins p JOIN np n USING (net) GROUP BY 1, 2),
scored AS (SELECT t.v, q.part AS p, t.part, size, (t.n - CASE WHEN t.part = q.part THEN 1 ELSE 0 END) * (1 - size / cap) AS score FROM touch t JOIN parts q USING (v) JOIN sizes s ON s.part = t.part, cap),
ranked AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, size, part) AS r FROM scored),
picked AS (SELECT v, p, CASE WHEN score > 0 THEN part ELSE (SELECT part FROM sizes ORDER BY size, part LIMIT 1) END AS q FROM ranked WHERE r = 1),
cand AS (SELECT v, p, q FROM picked JOIN sizes ON sizes.part = q, cap WHERE p <> q{rule})"""


def tv_gains(guard: bool) -> str:
    return f"""{_candidates(guard)},
gains AS (SELECT c.v, c.p, c.q, count(*) FILTER (a.cnt = 1) AS leave, count(*) FILTER (b.cnt IS NULL) AS arrive FROM cand c JOIN pins USING (v) LEFT JOIN np a ON a.net = pins.net AND a.part = c.p LEFT JOIN np b ON b.net = pins.net AND b.part = c.q GROUP BY 1, 2, 3)"""


def tv_moves(guard: bool) -> str:
    return f"{tv_gains(guard)},\nmoves AS (SELECT v, p AS from_part, q AS to_part, leave - arrive AS gain FROM gains WHERE leave >= arrive)"


_MESSAGE = """inc AS (SELECT pins.net, pins.v, parts.part AS p, src, sp FROM pins JOIN parts USING (v) JOIN sources USING (net)),
rec AS (SELECT DISTINCT v, p, part AS r FROM inc JOIN np USING (net) WHERE src = v AND (part <> p OR cnt > 1)),
snd AS (SELECT v, p, sp, min(net) AS net FROM inc WHERE src <> v GROUP BY 1, 2, 3),
gain AS (
  SELECT v, p, part, count(*) AS g FROM (
    SELECT v, p, p AS part FROM inc JOIN np USING (net) JOIN msg ON msg.sp = p AND msg.tp = np.part WHERE src = v AND np.part <> p AND mult = 1
    UNION ALL SELECT snd.v, p, snd.sp FROM snd JOIN np ON np.net = snd.net AND np.part = p AND cnt = 1 JOIN msg ON msg.sp = snd.sp AND msg.tp = p AND mult = 1) GROUP BY 1, 2, 3)"""

TM_MOVES = f"""{_MESSAGE},
saved AS (SELECT v, p, sum(g)::BIGINT AS g FROM gain GROUP BY 1, 2),
target AS (SELECT v, p, part AS k, g FROM saved, sizes, cap WHERE part <> p AND size < cap),
lost AS (SELECT v, k, count(*) AS l FROM (
  SELECT t.v, t.k FROM target t JOIN rec ON rec.v = t.v AND r <> k ANTI JOIN msg ON sp = k AND tp = r
  UNION ALL SELECT t.v, t.k FROM target t JOIN snd ON snd.v = t.v AND snd.sp <> k ANTI JOIN msg ON msg.sp = snd.sp AND tp = k) GROUP BY 1, 2),
moves AS (SELECT v, p AS from_part, k AS to_part, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, k) AS n FROM (SELECT t.v, p, t.k, g - coalesce(l, 0) AS gain FROM target t LEFT JOIN lost ON lost.v = t.v AND lost.k = t.k)) WHERE n = 1 AND gain > 0)"""

MSM_MOVES = f"""{_MESSAGE},
load AS (SELECT part, sent_messages AS load, (SELECT max(sent_messages) FROM vol) AS top FROM vol),
target AS (SELECT DISTINCT g.v, g.p, ks.part AS k FROM gain g, ks WHERE ks.part <> g.p),
change AS (SELECT v, p, k, part, sum(d)::BIGINT AS d FROM (
  SELECT t.v, t.p, t.k, part, g AS d FROM target t JOIN gain USING (v)
  UNION ALL SELECT t.v, t.p, t.k, t.k, -1 FROM target t JOIN rec ON rec.v = t.v AND r <> k ANTI JOIN msg ON sp = k AND tp = r
  UNION ALL SELECT t.v, t.p, t.k, snd.sp, -1 FROM target t JOIN snd ON snd.v = t.v AND snd.sp <> k ANTI JOIN msg ON msg.sp = snd.sp AND tp = k) GROUP BY 1, 2, 3, 4),
judged AS (SELECT v, p, k, count(*) FILTER (load = top AND d > 0) AS better, coalesce(sum(d) FILTER (load = top), 0)::BIGINT AS gain, count(*) FILTER (load < top AND load - d >= top) AS spoilt FROM change JOIN load USING (part) GROUP BY 1, 2, 3),
moves AS (SELECT v, p AS from_part, k AS to_part, gain FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, k) AS n FROM judged WHERE spoilt = 0 AND better = (SELECT count(*) FROM load WHERE load = top)) WHERE n = 1)"""


def volume_moves(received: bool) -> str:
    more = """
  UNION ALL SELECT v, p, q, p, -leaves FROM hit WHERE src <> v
  UNION ALL SELECT v, p, q, q, joins FROM hit WHERE src <> v""" if received else ""
    load = "send + recv" if received else "send"
    rule = "spoilt = 0 AND better = (SELECT count(*) FROM load WHERE load = top)" if received else "spoilt = 0"
    return f"""{_candidates(False)},
hit AS (SELECT c.v, c.p, c.q, src, sp, lam, CASE WHEN a.cnt = 1 THEN 1 ELSE 0 END AS leaves, CASE WHEN b.cnt IS NULL THEN 1 ELSE 0 END AS joins
  FROM cand c JOIN pins USING (v) JOIN sources ON sources.net = pins.net JOIN lam ON lam.net = pins.net LEFT JOIN np a ON a.net = pins.net AND a.part = c.p LEFT JOIN np b ON b.net = pins.net AND b.part = c.q),
load AS (SELECT part, {load} AS load, (SELECT max({load}) FROM vol) AS top FROM vol),
change AS (SELECT v, p, q, part, sum(d)::BIGINT AS d FROM (
  SELECT v, p, q, p AS part, 1 - lam AS d FROM hit WHERE src = v
  UNION ALL SELECT v, p, q, q, lam - 1 - leaves + joins FROM hit WHERE src = v
  UNION ALL SELECT v, p, q, sp, joins - leaves FROM hit WHERE src <> v{more}) GROUP BY 1, 2, 3, 4),
judged AS (SELECT v, p, q, count(*) FILTER (load = top AND d < 0) AS better, count(*) FILTER (load = top AND d > 0 OR load < top AND load + d >= top) AS spoilt, coalesce(sum(-d) FILTER (load = top), 0)::BIGINT AS gain FROM change JOIN load USING (part) GROUP BY 1, 2, 3),
moves AS (SELECT v, p AS from_part, q AS to_part, gain FROM judged WHERE {rule})"""


def moves(part: str, k: int, rule: str) -> str:
    return f"{state(part, k)},\n{rule}\nSELECT v, from_part, to_part, gain FROM moves"


def swept(part: str, k: int, rule: str) -> str:
    """The six metrics after one sweep of moves that do not meet on a net."""
    return f"""{state(part, k)},
{rule},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, to_part) AS o FROM moves) WHERE o = 1),
meet AS (SELECT pins.net, one.v, row_number() OVER (PARTITION BY pins.net ORDER BY gain DESC, one.v) AS o FROM pins JOIN one USING (v)),
free AS (SELECT * FROM one WHERE v NOT IN (SELECT v FROM meet WHERE o > 1)),
parts2 AS (SELECT parts.v, coalesce(free.to_part, parts.part) AS part FROM parts LEFT JOIN free USING (v)),
np2 AS (SELECT net, part, count(*) AS cnt FROM pins JOIN parts2 USING (v) GROUP BY 1, 2),
lam2 AS (SELECT net, count(*) AS lam FROM np2 GROUP BY 1),
sources2 AS (SELECT net, part AS sp FROM src JOIN parts2 ON v = src),
msg2 AS (SELECT sp, part AS tp, count(*) AS mult FROM np2 JOIN sources2 USING (net) WHERE sp <> part GROUP BY 1, 2),
send2 AS (SELECT sp AS part, sum(lam - 1) AS s FROM sources2 JOIN lam2 USING (net) GROUP BY 1),
recv2 AS (SELECT tp AS part, sum(mult) AS r FROM msg2 GROUP BY 1)
SELECT (SELECT count(*) FROM lam2 WHERE lam > 1) AS cn, (SELECT sum(lam - 1)::BIGINT FROM lam2) AS tv, (SELECT count(*) FROM msg2) AS tm,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM msg2 GROUP BY sp)) AS msm, (SELECT max(s)::BIGINT FROM send2) AS msv,
  (SELECT max(coalesce(s, 0) + coalesce(r, 0))::BIGINT FROM send2 FULL JOIN recv2 USING (part)) AS msrv"""


def placed(policy: str, k: int, source: str = "pins") -> str:
    """Table a(ord, v, part) of the sequential placement of the vertices of pins by id, nets read from ``source``."""
    only = "HAVING count(*) = 1" if policy == "cn" else ""
    return f"""ordv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS ord FROM (SELECT DISTINCT v FROM pins)),
lim AS (SELECT CAST(count(*) // {k} AS DOUBLE) * 1.05 AS cap FROM ordv),
a(ord, v, part) USING KEY (ord) AS (
  SELECT ord, v, 0::INTEGER FROM ordv WHERE ord = 0
  UNION (
  WITH cur AS (SELECT ord, v FROM ordv WHERE ord = (SELECT max(ord) + 1 FROM recurring.a)),
  sz AS (SELECT k.part, count(r.v) AS n FROM (SELECT unnest(range({k}))::INTEGER AS part) k LEFT JOIN recurring.a r ON r.part = k.part GROUP BY 1),
  tp AS (SELECT DISTINCT p.net, r.part FROM {source} p JOIN recurring.a r ON r.v = p.v WHERE p.net IN (SELECT net FROM {source} WHERE v = (SELECT v FROM cur))),
  ok AS (SELECT net FROM tp GROUP BY net {only}),
  sc AS (SELECT part, count(*) AS s FROM tp WHERE net IN (FROM ok) GROUP BY 1),
  ch AS (SELECT sz.part, greatest(0.0::DOUBLE, coalesce(s, 0) * (1 - n / cap)) AS score, n FROM sz LEFT JOIN sc USING (part), lim)
  SELECT cur.ord, cur.v, ch.part FROM ch, cur ORDER BY score DESC, n, ch.part LIMIT 1))"""


def bfs(start: str = "SELECT min(v) FROM pins", name: str = "b") -> str:
    """Table (v, level) of hops over common nets."""
    return f"""{name}(v, level) USING KEY (v) AS (
  SELECT ({start}), 0::INTEGER
  UNION (SELECT DISTINCT q.v, {name}.level + 1 FROM {name} JOIN pins p ON p.v = {name}.v JOIN pins q ON q.net = p.net WHERE q.v NOT IN (SELECT v FROM recurring.{name})))"""


def queue_order(start: str = "SELECT min(v) FROM pins") -> str:
    """Table q(v, level, ord) of a search with a queue that takes nets and pins by id, a level at a time."""
    return f"""q(v, level, ord) USING KEY (v) AS (
  SELECT ({start}), 0::INTEGER, 0::BIGINT
  UNION (SELECT v, level, ord + row_number() OVER (ORDER BY since, net, v) - 1 FROM (
    SELECT p.v, n.level + 1 AS level, (SELECT count(*) FROM recurring.q) AS ord, min(n.since) AS since, min_by(n.net, (n.since, n.net)) AS net
    FROM (SELECT pins.net, min(q.ord) AS since, any_value(q.level) AS level FROM q JOIN pins ON pins.v = q.v GROUP BY 1) n JOIN pins p ON p.net = n.net
    WHERE p.v NOT IN (SELECT v FROM recurring.q) GROUP BY 1, 2)))"""


#: Nets of the thinned hypergraph have two pins at most.
SPARSE = "sparse AS (SELECT * FROM pins WHERE net IN (SELECT net FROM pins GROUP BY 1 HAVING count(*) < 3))"


def components(source: str) -> str:
    """Table c(v, component) of the vertices of pins over the nets of ``source``."""
    return f"""c(v, component) USING KEY (v) AS (
  SELECT DISTINCT v, v FROM pins
  UNION (SELECT y.v, min(c.component) FROM c JOIN {source} x ON x.v = c.v JOIN {source} y ON y.net = x.net JOIN recurring.c r ON r.v = y.v GROUP BY y.v, r.component HAVING min(c.component) < r.component))"""


def similarity(bands: int, rows: int) -> str:
    """Tables sig(v, signature) of least hashes and c(v, component) of chains over buckets."""
    least = ", ".join(f"min((net % {PRIME} * {a} + {b}) % {PRIME})" for a, b in map(coefficients, range(bands * rows)))
    return f"""sig AS (SELECT v, [{least}] AS signature FROM pins GROUP BY v),
bucket AS (SELECT v, (b, signature[b * {rows} + 1 : b * {rows} + {rows}])::VARCHAR AS net FROM sig, range({bands}) t(b)),
{components("bucket")}"""


THIN = "kept AS (SELECT net FROM (SELECT net, count(*) AS d FROM pins GROUP BY 1) WHERE d < 1.5 * (SELECT count(*) / count(DISTINCT net) FROM pins) AND d < 10), thin AS (SELECT * FROM pins WHERE net IN (SELECT net FROM kept))"


def placed_by_messages(k: int) -> str:
    """Table a(ord, v, part) of the sequential placement by messages; connections are rebuilt of the whole prefix."""
    return f"""ordv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS ord FROM (SELECT DISTINCT v FROM pins)),
lim AS (SELECT CAST(count(*) // {k} AS DOUBLE) * 1.05 AS cap FROM ordv),
home AS (SELECT net, min(v) AS src FROM pins GROUP BY 1),
inc AS (SELECT pins.net, v, src FROM pins JOIN home USING (net)),
a(ord, v, part) USING KEY (ord) AS (
  SELECT ord, v, 0::INTEGER FROM ordv WHERE ord = 0
  UNION (
  WITH cur AS (SELECT ord, v FROM ordv WHERE ord = (SELECT max(ord) + 1 FROM recurring.a)),
  sz AS (SELECT k.part, count(r.v) AS n FROM (SELECT unnest(range({k}))::INTEGER AS part) k LEFT JOIN recurring.a r ON r.part = k.part GROUP BY 1),
  pt AS (SELECT i.net, r.part, i.v = i.src AS own FROM inc i JOIN recurring.a r ON r.v = i.v),
  linked AS (SELECT DISTINCT s.part AS sp, t.part AS tp FROM pt s JOIN pt t USING (net) WHERE s.own AND s.part <> t.part),
  mine AS (SELECT net, src = v AS own FROM inc WHERE v = (SELECT v FROM cur)),
  senders AS (SELECT DISTINCT part FROM mine m JOIN pt USING (net) WHERE pt.own AND NOT m.own),
  receivers AS (SELECT DISTINCT net, part FROM mine m JOIN pt USING (net) WHERE m.own),
  sc AS (SELECT part, count(*) AS s FROM (SELECT tp AS part FROM senders JOIN linked ON sp = part UNION ALL SELECT sp FROM receivers JOIN linked ON tp = part) GROUP BY 1),
  ch AS (SELECT sz.part, n, n < cap AS able, CASE WHEN n < cap THEN coalesce(s, 0) ELSE 0 END AS s FROM sz LEFT JOIN sc USING (part), lim)
  SELECT cur.ord, cur.v, ch.part FROM ch, cur ORDER BY able DESC, s DESC, n, ch.part LIMIT 1))"""


#: An order in which sources of nets stand anywhere.
MIXED = "v * 7919 % 1009, v"


def placed_in_batches(batches: int, k: int, policy: str = "tv", order: str = "v") -> str:
    """Table parts(v, part) of the placement in so many batches of an order."""
    steps = f"""ordv AS (SELECT v, row_number() OVER (ORDER BY {order}) - 1 AS ord FROM (SELECT DISTINCT v FROM pins)),
home AS (SELECT net, min(v) AS src FROM pins GROUP BY 1),
size_ AS (SELECT count(*) AS nov, (count(*) + {batches} - 1) // {batches} AS each, CAST(count(*) // {k} AS DOUBLE) * 1.05 AS cap FROM ordv),
ks AS (SELECT unnest(range({k}))::INTEGER AS part),
done0 AS (SELECT NULL::BIGINT AS v, NULL::INTEGER AS part WHERE false)"""
    for b in range(batches):
        by_nets = f"""best{b} AS (SELECT * FROM (SELECT v, part, n, s * (1 - n / cap) AS score, row_number() OVER (PARTITION BY v ORDER BY s * (1 - n / cap) DESC, n, part) AS r FROM vote{b} JOIN sz{b} USING (part), size_) WHERE r = 1 AND score > 0)"""
        only = f" AND t.net IN (SELECT net FROM tp{b} GROUP BY 1 HAVING count(*) = 1)" if policy == "cn" else ""
        touching = f"vote{b} AS (SELECT p.v, t.part, count(*) AS s FROM own{b} JOIN pins p USING (v) JOIN tp{b} t ON t.net = p.net{only} GROUP BY 1, 2),\n{by_nets}"
        by_messages = f"""so{b} AS (SELECT net, part AS sp FROM home JOIN done{b} ON v = src),
cx{b} AS (SELECT DISTINCT sp, part AS tp FROM so{b} JOIN tp{b} USING (net) WHERE sp <> part),
inc{b} AS (SELECT v, net, src = v AS own FROM own{b} JOIN pins USING (v) JOIN home USING (net)),
vote{b} AS (SELECT v, part, sum(s) AS s FROM (
  SELECT v, tp AS part, 1 AS s FROM (SELECT DISTINCT v, sp FROM inc{b} JOIN so{b} USING (net) WHERE NOT own) JOIN cx{b} USING (sp)
  UNION ALL SELECT v, sp, 1 FROM inc{b} JOIN tp{b} USING (net) JOIN cx{b} ON tp = part WHERE own) GROUP BY 1, 2),
best{b} AS (SELECT v, part, n, score FROM (SELECT v, part, n, s AS score, row_number() OVER (PARTITION BY v ORDER BY s DESC, n, part) AS r FROM vote{b} JOIN sz{b} USING (part), size_ WHERE n < cap) WHERE r = 1)"""
        steps += f""",
own{b} AS (SELECT v, ord FROM ordv, size_ WHERE ord // each = {b}),
sz{b} AS (SELECT ks.part, count(v) AS n FROM ks LEFT JOIN done{b} USING (part) GROUP BY 1),
tp{b} AS (SELECT DISTINCT net, part FROM pins JOIN done{b} USING (v)),
{by_messages if policy == "tm" else touching},
fit{b} AS (SELECT v, part FROM (SELECT v, part, n, cap, row_number() OVER (PARTITION BY part ORDER BY score DESC, ord) AS r FROM best{b} JOIN own{b} USING (v), size_) WHERE r <= greatest(ceil(cap) - n, 0)),
left{b} AS (SELECT sz{b}.part, n + count(v) AS n FROM sz{b} LEFT JOIN fit{b} USING (part) GROUP BY sz{b}.part, n),
wait{b} AS (SELECT v, row_number() OVER (ORDER BY ord) AS place FROM own{b} WHERE v NOT IN (SELECT v FROM fit{b})),
spot{b} AS (SELECT part, row_number() OVER (ORDER BY level, part) AS place FROM (SELECT part, unnest(range(n, n + (SELECT count(*) FROM wait{b}))) AS level FROM left{b})),
done{b + 1} AS (SELECT v, part FROM done{b} UNION ALL SELECT v, part FROM fit{b} UNION ALL SELECT v, part FROM wait{b} JOIN spot{b} USING (place))"""
    return f"{steps},\nparts AS (SELECT v, part FROM done{batches})"


_ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, to_part) AS o FROM moves) WHERE o = 1)"


def _admission(k: int, objective: str) -> tuple[str, str]:
    """Table expressions, and the moves of ``one`` that are applied, as sizes and loads are looked at again."""
    if objective == "cn":
        return "", "SELECT v, from_part, to_part, gain FROM one"
    if objective == "tm":
        return "", "SELECT v, from_part, to_part, gain FROM (SELECT one.*, size, row_number() OVER (PARTITION BY to_part ORDER BY v) - 1 AS arrived FROM one JOIN sizes ON part = to_part), cap WHERE size + arrived < 1.02::DOUBLE * cap"
    if objective == "tv":
        return f""",
ev AS (SELECT v, to_part AS part, 1 AS step, true AS asks FROM one UNION ALL SELECT v, from_part, -1, false FROM one),
run AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY part ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev),
stop AS (SELECT min(v) AS last FROM run JOIN sizes USING (part) WHERE asks AND size + before > 1.1::DOUBLE * (SELECT count(*) FROM parts) / {k})""", "SELECT v, from_part, to_part, gain FROM one, stop WHERE last IS NULL OR v < last"
    delta = "SELECT one.v, part, -d AS d FROM change JOIN one ON one.v = change.v AND to_part = k" if objective == "msm" else "SELECT one.v, part, d FROM change JOIN one ON one.v = change.v AND to_part = q"
    return f""",
delta AS ({delta}),
grid AS (SELECT one.v, l.part, load, top, load + sum(coalesce(d, 0)) OVER (PARTITION BY l.part ORDER BY one.v) AS now FROM one CROSS JOIN load l LEFT JOIN delta ON delta.v = one.v AND delta.part = l.part),
stop AS (SELECT min(v) AS last FROM (SELECT v FROM grid GROUP BY v HAVING max(now) = max(now) FILTER (load < top)))""", "SELECT v, from_part, to_part, gain FROM one, stop WHERE last IS NULL OR v <= last"


def admitted(part: str, k: int, rule: str, objective: str) -> str:
    """The moves of one batch of all vertices that are applied."""
    tables, chosen = _admission(k, objective)
    return f"{state(part, k)},\n{rule},\n{_ONE}{tables}\n{chosen}"


def refined_in_batches(part: str, k: int, rule: str, objective: str, batches: int) -> str:
    """The parts after one sweep in so many batches of the vertices by id."""
    tables, chosen = _admission(k, objective)
    out = f"""{pins()},
ordv AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) // ((count(*) OVER () + {batches} - 1) // {batches}) AS b FROM (SELECT DISTINCT v FROM pins)),
p0 AS (SELECT DISTINCT v, {part} AS part FROM pins)"""
    for b in range(batches):
        one = _ONE.replace("FROM moves)", f"FROM moves WHERE v IN (SELECT v FROM ordv WHERE b = {b}))")
        out += f""",
p{b + 1} AS MATERIALIZED (SELECT * FROM (WITH parts AS (SELECT * FROM p{b}), {_tables(k)},
{rule},
{one}{tables},
applied AS ({chosen})
SELECT parts.v, coalesce(to_part, part) AS part FROM parts LEFT JOIN applied ON applied.v = parts.v))"""
    return f"{out}\nSELECT v, part FROM p{batches}"


def coloured(part: str, k: int, rule: str) -> str:
    """The moves' colours, given one by one: highest priority first, the least colour that none it meets has."""
    return f"""{state(part, k)},
{rule},
{_ONE},
own AS (SELECT net, one.* FROM pins JOIN one USING (v)),
out AS (SELECT net, from_part AS part, count(*) AS n FROM own GROUP BY 1, 2),
firm AS (SELECT np.net, np.part FROM np LEFT JOIN out ON out.net = np.net AND out.part = np.part WHERE cnt > coalesce(n, 0)),
met AS (SELECT net, v FROM own WHERE NOT EXISTS (SELECT 1 FROM firm WHERE firm.net = own.net AND firm.part = from_part) OR NOT EXISTS (SELECT 1 FROM firm WHERE firm.net = own.net AND firm.part = to_part)),
turn AS (SELECT v, row_number() OVER (ORDER BY v * 7919 % 1009 DESC, v DESC) - 1 AS o FROM (SELECT DISTINCT v FROM one)),
near AS (SELECT DISTINCT x.v, y.v AS w FROM met x JOIN met y USING (net) WHERE x.v <> y.v),
c(o, v, colour) USING KEY (o) AS (
  SELECT o, v, 0 FROM turn WHERE o = 0
  UNION (
  WITH cur AS (SELECT o, v FROM turn WHERE o = (SELECT max(o) + 1 FROM recurring.c)),
  seen AS (SELECT DISTINCT r.colour FROM recurring.c r JOIN near ON near.w = r.v WHERE near.v = (SELECT v FROM cur))
  SELECT cur.o, cur.v, (SELECT min(x) FROM range(0, (SELECT count(*) + 1 FROM seen)) t(x) WHERE x NOT IN (SELECT colour FROM seen))::INTEGER FROM cur))
SELECT v, colour FROM c"""


def swept_twice(part: str, k: int, rule: str) -> str:
    """The six metrics after two sweeps of moves that do not meet on a net."""
    once = lambda before: f"""SELECT * FROM (WITH parts AS (SELECT * FROM {before}), {_tables(k)},
{rule},
{_ONE},
meet AS (SELECT pins.net, one.v, row_number() OVER (PARTITION BY pins.net ORDER BY gain DESC, one.v) AS o FROM pins JOIN one USING (v)),
free AS (SELECT * FROM one WHERE v NOT IN (SELECT v FROM meet WHERE o > 1))
SELECT parts.v, coalesce(free.to_part, parts.part) AS part FROM parts LEFT JOIN free USING (v))"""  # noqa: E731
    return f"""{pins()},
p0 AS (SELECT DISTINCT v, {part} AS part FROM pins),
p1 AS ({once("p0")}),
p2 AS ({once("p1")}),
parts AS (SELECT * FROM p2), {_tables(k)}
SELECT {METRICS}"""


#: The hypergraph with nets and vertices numbered from 0, as files have them.
DENSE = """numbered AS (SELECT dense_rank() OVER (ORDER BY net) - 1 AS net, dense_rank() OVER (ORDER BY v) - 1 AS v FROM pins)"""
#: Parts and suppliers as a matrix.
MATRIX = "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), i AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS n FROM (SELECT a FROM e UNION SELECT b FROM e)), g AS (SELECT x.n AS i, y.n AS j, (1 + (x.n + y.n) % 5)::DOUBLE AS w FROM e JOIN i x ON x.a = e.a JOIN i y ON y.a = e.b WHERE x.n <> y.n)"
#: Suppliers and products numbered by supplier as a dense matrix.
ARRAY = "WITH n AS (SELECT max(l_suppkey) + 1 AS n FROM lineitem), e AS (SELECT DISTINCT l_suppkey AS i, l_partkey % n AS j FROM lineitem, n), g AS (SELECT i, j, (1 + (i + j) % 5)::DOUBLE AS w FROM e)"
