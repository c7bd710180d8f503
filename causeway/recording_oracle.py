"""SQL for the queries on recordings: correlated subqueries, range joins and recursion where the Spark forms use windows, shards and bins."""

from __future__ import annotations

import re

from causeway.sources.ring import ACTS

_ONE = """t AS (SELECT 'run' AS run_id, id, max(parent) AS parent, max(name) AS name, max(kind) AS kind, max(loc_file) AS loc_file, max(loc_line) AS loc_line, min(spawn_ts) AS spawn_ts, max(end_ts) AS end_ts FROM tasks WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT 'run' AS run_id, id, max(concrete_type) AS concrete_type, max(loc_file) AS loc_file, max(loc_line) AS loc_line, min(new_ts) AS new_ts, max(drop_ts) AS drop_ts FROM resources WHERE id IS NOT NULL GROUP BY id),
po AS (SELECT DISTINCT 'run' AS run_id, id, task, start_ts, end_ts FROM polls WHERE id IS NOT NULL),
pa AS (SELECT DISTINCT 'run' AS run_id, id, task, resource, op_name, ts FROM parks WHERE id IS NOT NULL),
wa AS (SELECT DISTINCT 'run' AS run_id, id, woken, ts FROM wakes WHERE id IS NOT NULL),
st AS (SELECT DISTINCT 'run' AS run_id, id, resource, field, value, op, ts FROM resource_state WHERE id IS NOT NULL)"""

_BOUNDS = """bo AS (SELECT run_id, coalesce(min(lo), 0) AS min_ts, coalesce(max(hi), 0) AS max_ts FROM (
  SELECT run_id, spawn_ts AS lo, greatest(spawn_ts, end_ts) AS hi FROM t UNION ALL SELECT run_id, new_ts, greatest(new_ts, drop_ts) FROM r UNION ALL SELECT run_id, start_ts, greatest(start_ts, end_ts) FROM po
  UNION ALL SELECT run_id, ts, ts FROM pa UNION ALL SELECT run_id, NULL, ts FROM wa UNION ALL SELECT run_id, ts, ts FROM st) GROUP BY run_id),
en AS (SELECT run_id, max_ts AS at FROM bo)"""

_PAIR = (
    _ONE.replace("t AS (", "t0 AS (", 1).replace("\nr AS", "\nr0 AS").replace("\npo AS", "\npo0 AS").replace("\npa AS", "\npa0 AS").replace("\nwa AS", "\nwa0 AS").replace("\nst AS", "\nst0 AS")
    + """,
m AS (SELECT (SELECT max(greatest(a, b)) FROM (SELECT max(greatest(spawn_ts, end_ts)) a, 0 b FROM t0 UNION ALL SELECT max(greatest(new_ts, drop_ts)), 0 FROM r0 UNION ALL SELECT max(greatest(start_ts, end_ts)), 0 FROM po0
  UNION ALL SELECT max(ts), 0 FROM pa0 UNION ALL SELECT max(ts), 0 FROM wa0 UNION ALL SELECT max(ts), 0 FROM st0)) // 2 AS mid),
t AS (SELECT 'base' AS run_id, id, parent, name, kind, loc_file, loc_line, spawn_ts, CASE WHEN end_ts < mid THEN end_ts END AS end_ts FROM t0, m WHERE spawn_ts < mid
  UNION ALL SELECT 'cur', id, parent, name, kind, loc_file, loc_line, spawn_ts, end_ts FROM t0, m WHERE end_ts IS NULL OR end_ts >= mid),
r AS (SELECT 'base' AS run_id, id, concrete_type, loc_file, loc_line, new_ts, CASE WHEN drop_ts < mid THEN drop_ts END AS drop_ts FROM r0, m WHERE new_ts < mid
  UNION ALL SELECT 'cur', id, concrete_type, loc_file, loc_line, new_ts, drop_ts FROM r0, m WHERE drop_ts IS NULL OR drop_ts >= mid),
po AS (SELECT CASE WHEN start_ts < mid THEN 'base' ELSE 'cur' END AS run_id, id, task, start_ts, end_ts FROM po0, m),
pa AS (SELECT CASE WHEN ts < mid THEN 'base' ELSE 'cur' END AS run_id, id, task, resource, op_name, ts FROM pa0, m),
wa AS (SELECT CASE WHEN ts < mid THEN 'base' ELSE 'cur' END AS run_id, id, woken, ts FROM wa0, m),
st AS (SELECT CASE WHEN ts < mid THEN 'base' ELSE 'cur' END AS run_id, id, resource, field, value, op, ts FROM st0, m)"""
)

_RING = f"""ac AS ({ACTS}),
t AS (SELECT DISTINCT concat('region-', rg) AS run_id, task AS id, name, 'task' AS kind, 'ring.rs' AS loc_file, 1 AS loc_line, 0::BIGINT AS spawn_ts, NULL::BIGINT AS end_ts FROM ac),
r AS (SELECT DISTINCT concat('region-', rg) AS run_id, res AS id, CASE WHEN res = 6000 THEN 'mpsc::channel' ELSE 'Mutex' END AS concrete_type, 'ring.rs' AS loc_file,
  CASE WHEN res = 6000 THEN 999 WHEN res >= 5000 THEN res % 1000 + 100 ELSE res % 1000 END AS loc_line, 0::BIGINT AS new_ts, NULL::BIGINT AS drop_ts FROM (SELECT rg, res FROM ac UNION SELECT rg, 6000 FROM ac)),
po AS (SELECT concat('region-', rg) AS run_id, t * 8 + 3 AS id, task, t AS start_ts, t + 2 AS end_ts FROM ac),
pa AS (SELECT concat('region-', rg) AS run_id, t * 8 + 2 AS id, task, res AS resource, 'poll_acquire' AS op_name, t + 1 AS ts FROM ac WHERE act = 'park'),
wa AS (SELECT NULL::VARCHAR AS run_id, 0::BIGINT AS id, 0::BIGINT AS woken, 0::BIGINT AS ts WHERE false),
st AS (SELECT concat('region-', rg) AS run_id, t * 8 + 2 AS id, res AS resource, 'acquired_by' AS field, task AS value, 'override' AS op, t + 1 AS ts FROM ac WHERE act <> 'park'
  UNION ALL SELECT concat('region-', rg), no, 6000, 'permits', v, o, no FROM (SELECT DISTINCT rg FROM ac), (VALUES (1, 2, 'override'), (2, 1, 'sub'), (3, 1, 'sub')) p(no, v, o))"""

_GRID = "gi AS (SELECT run_id, (max_ts * g) // 3 AS at FROM bo, (VALUES (1), (2), (3)) v(g))"
_END = "gi AS (SELECT * FROM en)"

_STATUS = """ids AS (SELECT gi.run_id, at, t.id AS task FROM gi JOIN t USING (run_id) UNION SELECT gi.run_id, at, task FROM gi JOIN po ON po.run_id = gi.run_id AND start_ts <= at),
la AS (SELECT gi.run_id, at, task, bool_or(start_ts <= at AND (end_ts IS NULL OR end_ts > at)) AS running,
    max((end_ts, start_ts, id)) FILTER (start_ts <= at AND end_ts <= at) AS l FROM gi JOIN po USING (run_id) WHERE start_ts <= at GROUP BY ALL),
pk AS (SELECT la.run_id, at, la.task, arg_max(resource, (ts, pa.id)) AS resource FROM la JOIN pa ON pa.run_id = la.run_id AND pa.task = la.task AND ts BETWEEN l[2] AND l[1] WHERE NOT running GROUP BY ALL),
ss AS (SELECT ids.run_id, ids.at, ids.task, spawn_ts, coalesce(spawn_ts <= ids.at, false) AS visible, t.parent AS parent,
    CASE WHEN end_ts <= ids.at THEN 'done' WHEN coalesce(running, false) THEN 'running' WHEN pk.task IS NOT NULL THEN 'parked' ELSE 'idle' END AS state, pk.resource AS parked_on
  FROM ids LEFT JOIN t ON t.run_id = ids.run_id AND t.id = ids.task LEFT JOIN la ON la.run_id = ids.run_id AND la.at = ids.at AND la.task = ids.task
  LEFT JOIN pk ON pk.run_id = ids.run_id AND pk.at = ids.at AND pk.task = ids.task)"""
_NO_PARENT = _STATUS.replace("t.parent AS parent", "NULL AS parent")

_HOLDER = """ho AS (SELECT x.run_id, x.at, x.resource, x.holder FROM (
    SELECT gi.run_id, at, resource, arg_max(CASE WHEN field = 'acquired_by' THEN value ELSE NULL END, (ts, id)) AS h0, max((ts, id, CASE WHEN field = 'acquired_by' THEN value END)) AS l FROM gi JOIN st USING (run_id)
    WHERE ts <= at AND (field = 'acquired_by' OR (field = 'locked' AND value = 0)) GROUP BY ALL) y, LATERAL (SELECT y.run_id, y.at, y.resource, y.l[3] AS holder) x
  WHERE x.holder IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = x.run_id AND r.id = x.resource AND drop_ts <= x.at)
    AND NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = x.run_id AND t.id = x.holder AND end_ts <= x.at))"""

_PERMITS = """pm AS (SELECT gi.run_id, at, resource,
    list_reduce(list_prepend({'op': 'start', 'v': NULL::BIGINT}, list({'op': CASE WHEN op IN ('add', 'sub') THEN op ELSE 'set' END, 'v': value} ORDER BY ts, id) FILTER (field = 'permits')),
      lambda a, x: {'op': 'r', 'v': CASE x.op WHEN 'add' THEN coalesce(a.v, 0) + x.v WHEN 'sub' THEN coalesce(a.v, 0) - x.v ELSE x.v END}).v AS permits,
    (list(value ORDER BY ts, id) FILTER (field = 'permits' AND op NOT IN ('add', 'sub')))[1] AS capacity,
    CAST((list(value ORDER BY ts, id) FILTER (field = 'locked'))[-1] <> 0 AS INT) AS locked
  FROM gi JOIN st USING (run_id) WHERE ts <= at AND field IN ('permits', 'locked') GROUP BY ALL)"""

_EPISODES = """ep AS (SELECT pa.run_id, pa.id, pa.task, pa.resource, op_name, ts, coalesce((SELECT min(start_ts) FROM po WHERE po.run_id = pa.run_id AND po.task = pa.task AND start_ts > ts),
      (SELECT end_ts FROM t WHERE t.run_id = pa.run_id AND t.id = pa.task), at) AS end_ts, at FROM pa JOIN en ON en.run_id = pa.run_id WHERE ts <= at),
pe AS (SELECT run_id, id, task, resource, op_name, ts, end_ts, greatest(0, least(end_ts, at) - ts) AS dur FROM ep),
ti AS (SELECT run_id, id FROM r WHERE concrete_type IN ('Sleep', 'Interval', 'Timeout'))"""

_HOLDS = """hs AS (SELECT st.run_id, resource, ts, id, at, CASE WHEN field = 'acquired_by' THEN value END AS task FROM st JOIN en USING (run_id) WHERE ts <= at AND (field = 'acquired_by' OR (field = 'locked' AND value = 0))),
nx AS (SELECT a.run_id, a.id, min(b.ts) AS ts FROM hs a JOIN hs b ON b.run_id = a.run_id AND b.resource = a.resource AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) GROUP BY ALL),
hd AS (SELECT a.run_id, a.resource, a.task, a.id, a.ts AS start_ts, greatest(a.ts, coalesce(nx.ts, least(at, drop_ts, end_ts))) AS end_ts FROM hs a LEFT JOIN nx ON nx.run_id = a.run_id AND nx.id = a.id
  LEFT JOIN r ON r.run_id = a.run_id AND r.id = a.resource LEFT JOIN t ON t.run_id = a.run_id AND t.id = a.task WHERE a.task IS NOT NULL)"""

_LINKS = """bp AS (SELECT ss.run_id, ss.at, ss.task, arg_max((ts, op_name), (coalesce(op_name <> 'poll', false), ts, pa.id)) AS b FROM ss JOIN pa ON pa.run_id = ss.run_id AND pa.task = ss.task AND pa.resource = ss.parked_on AND ts <= ss.at
    WHERE state = 'parked' GROUP BY ALL),
li AS (SELECT ss.run_id, ss.at, ss.task, parked_on AS resource, b[2] AS op, b[1] AS since, greatest(0, ss.at - b[1]) AS wait_ns, holder, spawn_ts, visible
  FROM ss JOIN bp ON bp.run_id = ss.run_id AND bp.at = ss.at AND bp.task = ss.task LEFT JOIN ho ON ho.run_id = ss.run_id AND ho.at = ss.at AND ho.resource = ss.parked_on WHERE state = 'parked')"""

_WALK = """wk AS (SELECT run_id, at, task, [task] AS chain, holder AS nxt, resource AS last, false AS fin FROM li
  UNION ALL SELECT w.run_id, w.at, w.task, list_append(w.chain, w.nxt), l.holder, l.resource, false FROM wk w JOIN li l ON l.run_id = w.run_id AND l.at = w.at AND l.task = w.nxt WHERE NOT list_contains(w.chain, w.nxt)),
wb AS (SELECT run_id, at, task, arg_max(chain, len(chain)) AS chain, arg_max(nxt, len(chain)) AS n0, max((len(chain), nxt))[2] AS nxt, arg_max(last, len(chain)) AS last FROM wk GROUP BY ALL),
wy AS (SELECT run_id, at, task, CASE WHEN list_contains(chain, nxt) THEN 'deadlock' WHEN nxt IS NOT NULL THEN 'active_holder' ELSE 'resource_root' END AS outcome, chain,
    CASE WHEN list_contains(chain, nxt) THEN chain[list_position(chain, nxt):] END AS cycle, CASE WHEN NOT coalesce(list_contains(chain, nxt), false) THEN coalesce(nxt, last) END AS root FROM wb)"""

_DEAD = """dl AS (SELECT wy.run_id, wy.at, list_sort(cycle) AS members, arg_min((chain, cycle), (spawn_ts, wy.task)) AS f FROM wy JOIN li ON li.run_id = wy.run_id AND li.at = wy.at AND li.task = wy.task
    WHERE outcome = 'deadlock' AND visible GROUP BY ALL),
dk AS (SELECT run_id, at, members, f[2] AS cycle, list_transform(list_filter(f[1], lambda x: list_contains(members, x)), lambda x: x) AS inner_chain FROM dl),
de AS (SELECT dk.run_id, dk.at, members, cycle, list(resource ORDER BY list_position(inner_chain, li.task)) AS resources FROM dk JOIN li ON li.run_id = dk.run_id AND li.at = dk.at AND list_contains(members, li.task) GROUP BY ALL)"""

_GAPS = """ws AS (SELECT t.run_id, t.id AS task, least(spawn_ts, at) AS w0, least(end_ts, at) AS w1 FROM t JOIN en USING (run_id)),
cp AS (SELECT po.run_id, po.task, id, greatest(start_ts, w0) AS s, least(coalesce(end_ts, w1), w1) AS e, w0, w1 FROM po JOIN ws USING (run_id, task) WHERE start_ts <= w1 AND (end_ts IS NULL OR end_ts >= w0)),
cu AS (SELECT run_id, task, s, e, w0, w1, id, 1 AS k FROM cp WHERE e >= s UNION ALL SELECT run_id, task, w1, NULL, w0, w1, 0, 2 FROM ws),
ga AS (SELECT *, greatest(w0, max(e) OVER (PARTITION BY run_id, task ORDER BY s, k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS g0,
    lag(s) OVER (PARTITION BY run_id, task ORDER BY s, k, id) AS ps, lag(e) OVER (PARTITION BY run_id, task ORDER BY s, k, id) AS pe FROM cu),
gw AS (SELECT ga.*, (SELECT min(ts) FROM wa WHERE wa.run_id = ga.run_id AND wa.woken = ga.task AND ts > g0 AND ts <= s) AS wake,
    (SELECT max((coalesce(op_name <> 'poll', false), ts, pa.id, resource, op_name)) FROM pa WHERE pa.run_id = ga.run_id AND pa.task = ga.task AND ts BETWEEN ps AND pe) AS park FROM ga WHERE s > g0),
gt AS (SELECT gw.*, park[4] AS resource, park[5] AS op, park[2] AS since, coalesce(wake, s) - g0 AS wait_ns, s - coalesce(wake, s) AS lag_ns, ti.id IS NOT NULL AS timer FROM gw LEFT JOIN ti ON ti.run_id = gw.run_id AND ti.id = park[4])"""

_BLAMED = """hh AS (SELECT DISTINCT run_id, resource, greatest(since, g0) AS tt FROM gt WHERE resource IS NOT NULL),
hl AS (SELECT hh.run_id, hh.resource, tt, max((ts, st.id, CASE WHEN field = 'acquired_by' THEN value END))[3] AS h FROM hh JOIN st ON st.run_id = hh.run_id AND st.resource = hh.resource AND ts <= tt
    AND (field = 'acquired_by' OR (field = 'locked' AND value = 0)) GROUP BY ALL),
hx AS (SELECT * FROM hl WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = hl.run_id AND r.id = hl.resource AND drop_ts <= tt) AND NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = hl.run_id AND t.id = h AND end_ts <= tt)),
bw AS (SELECT gt.run_id, gt.task, g0, s AS g1, gt.resource, op, since, wait_ns, lag_ns, CAST(timer AS INT) AS timer, CASE WHEN h <> gt.task AND NOT timer THEN h END AS holder
  FROM gt LEFT JOIN hx ON hx.run_id = gt.run_id AND hx.resource = gt.resource AND tt = greatest(since, g0) WHERE gt.resource IS NOT NULL)"""

_DEPTHS = """dp AS (SELECT *, op NOT IN ('add', 'sub') AS sets, count(*) FILTER (op NOT IN ('add', 'sub')) OVER w AS g FROM st WHERE field = 'permits' WINDOW w AS (PARTITION BY run_id, resource ORDER BY ts, id)),
dr AS (SELECT *, sum(CASE op WHEN 'sub' THEN -value ELSE value END) OVER (PARTITION BY run_id, resource, g ORDER BY ts, id) AS permits FROM dp),
dc AS (SELECT run_id, resource, arg_min(value, (ts, id)) FILTER (sets) AS capacity, min(permits) AS least FROM dr GROUP BY ALL),
cd AS (SELECT run_id, resource, capacity, CAST(capacity - least AS BIGINT) AS max_depth FROM dc WHERE capacity IS NOT NULL),
fc AS (SELECT cd.* FROM cd JOIN r ON r.run_id = cd.run_id AND r.id = cd.resource WHERE capacity > 1)"""

_LABELS = """tk AS (SELECT run_id, id, coalesce(name, CASE WHEN loc_file IS NOT NULL OR loc_line IS NOT NULL THEN concat(CASE WHEN kind IS NULL OR kind = 'other' THEN 'task' ELSE kind END, '@', CASE WHEN loc_file IS NULL THEN '<unknown>'
    WHEN loc_line IS NULL THEN loc_file ELSE concat(loc_file, ':', loc_line) END) END) AS k0, CASE WHEN kind IS NULL OR kind = 'other' THEN 'task' ELSE kind END AS kd FROM t),
rk AS (SELECT run_id, id, concat(coalesce(concrete_type, '?'), CASE WHEN loc_file IS NULL AND loc_line IS NULL THEN '' ELSE concat('@', CASE WHEN loc_file IS NULL THEN '<unknown>' WHEN loc_line IS NULL THEN loc_file
    ELSE concat(loc_file, ':', loc_line) END) END) AS key, concrete_type FROM r)"""


def _merged(keys: str, no: str = "") -> str:
    """The union length and longest stretch of waits, by running ends."""
    return f"""iv{no} AS (SELECT run_id, {keys}, ts AS s, ts + dur AS e, id FROM pe WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.run_id = pe.run_id AND ti.id = pe.resource)),
io{no} AS (SELECT *, max(e) OVER (PARTITION BY run_id, {keys} ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM iv{no}),
ig{no} AS (SELECT *, sum(CASE WHEN c IS NULL OR s > c THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, {keys} ORDER BY s, e, id) AS g FROM io{no}),
im{no} AS (SELECT run_id, {keys}, g, max(e) - min(s) AS len FROM ig{no} GROUP BY ALL),
mw{no} AS (SELECT run_id, {keys}, CAST(sum(len) AS BIGINT) AS total, max(len) AS longest FROM im{no} GROUP BY ALL)"""


_TASK_GROUPS = """pl AS (SELECT po.run_id, task, CAST(sum(greatest(0, least(end_ts, at) - start_ts)) AS BIGINT) AS p, max(greatest(0, least(end_ts, at) - start_ts)) AS m FROM po JOIN en USING (run_id) WHERE start_ts <= at GROUP BY ALL),
tg AS (SELECT tk.run_id, coalesce(k0, concat('<unnamed ', kd, '>')) AS key, count(*) AS instances, CAST(coalesce(sum(p), 0) AS BIGINT) AS poll_ns, coalesce(max(m), 0) AS max_poll_ns,
    CAST(coalesce(sum(total), 0) AS BIGINT) AS wait_ns, coalesce(max(longest), 0) AS max_wait_ns
  FROM tk LEFT JOIN pl ON pl.run_id = tk.run_id AND pl.task = tk.id LEFT JOIN mw ON mw.run_id = tk.run_id AND mw.task = tk.id GROUP BY ALL)"""

_EDGES = """tr AS (SELECT st.run_id, value AS task, resource, ts, id, 0 AS ord FROM st JOIN en USING (run_id) WHERE field = 'acquired_by' AND ts <= at
  UNION ALL SELECT pa.run_id, task, resource, ts, id, 1 FROM pa JOIN en USING (run_id) WHERE ts <= at AND NOT EXISTS (SELECT 1 FROM ti WHERE ti.run_id = pa.run_id AND ti.id = pa.resource)),
eg AS (SELECT tr.run_id, hd.resource AS held, tr.resource, count(DISTINCT tr.task) AS tasks, min(ts) AS first_ts FROM tr JOIN hd ON hd.run_id = tr.run_id AND hd.task = tr.task AND start_ts < ts AND end_ts > ts AND hd.resource <> tr.resource GROUP BY ALL)"""




def _cycles(most: int) -> str:
    """The simple cycles of up to so many locks, from their least one; of a run the first 128 in the order of their paths."""
    return f"""ee AS (SELECT run_id, held AS a, resource AS b FROM eg WHERE EXISTS (SELECT 1 FROM hd WHERE hd.run_id = eg.run_id AND hd.resource = eg.resource)),
cy AS (SELECT run_id, [a, b] AS path FROM ee WHERE b > a
  UNION ALL SELECT cy.run_id, list_append(path, b) FROM cy JOIN ee ON ee.run_id = cy.run_id AND ee.a = path[-1] WHERE b > path[1] AND NOT list_contains(path, b) AND len(path) < {most}),
cc AS (SELECT run_id, path FROM (SELECT cy.run_id, path, row_number() OVER (PARTITION BY cy.run_id ORDER BY path) AS no FROM cy JOIN ee ON ee.run_id = cy.run_id AND ee.a = path[-1] AND ee.b = path[1]) WHERE no <= 128)"""


#: Witnesses of each cycle: every combination of one per edge with distinct tasks, in the order of the edges' lists.
_CHOSEN = """tp AS (SELECT tr.run_id, tr.task, tr.resource, tr.ts, tr.ord, tr.id, hd.resource AS held FROM tr JOIN hd ON hd.run_id = tr.run_id AND hd.task = tr.task AND start_ts < ts AND end_ts > ts AND hd.resource <> tr.resource),
tg2 AS (SELECT run_id, task, resource, ts, ord, id, list(DISTINCT held) AS gate FROM tp GROUP BY ALL),
wi AS (SELECT tp.run_id, held, tp.resource, tp.task, arg_min((tp.ts, gate), (tp.ts, tp.ord, CASE WHEN tp.ord = 0 THEN tp.ts ELSE tp.id END, tp.id)) AS w, min((tp.ord, CASE WHEN tp.ord = 0 THEN tp.ts ELSE tp.id END, tp.id)) AS turn
  FROM tp JOIN tg2 ON tg2.run_id = tp.run_id AND tg2.task = tp.task AND tg2.resource = tp.resource AND tg2.ts = tp.ts AND tg2.ord = tp.ord AND tg2.id = tp.id GROUP BY ALL),
wn AS (SELECT run_id, held, resource, task, w[1] AS ts, w[2] AS gate, row_number() OVER (PARTITION BY run_id, held, resource ORDER BY turn) AS no FROM wi),
cb AS (SELECT cc.run_id, path, 1 AS k, [wn.task] AS tasks, [wn.ts] AS times, [wn.no] AS nos, gate FROM cc JOIN wn ON wn.run_id = cc.run_id AND wn.held = path[1] AND wn.resource = path[2]
  UNION ALL SELECT cb.run_id, path, k + 1, list_append(tasks, wn.task), list_append(times, wn.ts), list_append(nos, wn.no), list_intersect(cb.gate, wn.gate)
  FROM cb JOIN wn ON wn.run_id = cb.run_id AND wn.held = path[k + 1] AND wn.resource = path[(k + 1) % len(path) + 1] WHERE k < len(path) AND NOT list_contains(tasks, wn.task)),
cr AS (SELECT *, len(list_filter(gate, lambda x: NOT list_contains(path, x))) = 0 AS fits, row_number() OVER (PARTITION BY run_id, path ORDER BY nos) AS turn FROM cb WHERE k = len(path)),
cx AS (SELECT run_id, path, arg_min((tasks, times), nos) FILTER (fits) AS f FROM cr WHERE turn <= 4096 GROUP BY ALL),
ch AS (SELECT cc.run_id, cc.path, f[1] AS tasks, f[2] AS times, CASE WHEN cx.path IS NULL THEN 'single_task' WHEN f IS NULL THEN 'guarded' ELSE 'valid' END AS outcome,
    EXISTS (SELECT 1 FROM de WHERE de.run_id = cc.run_id AND list_sort(list_distinct(resources)) = list_sort(cc.path)) AS observed FROM cc LEFT JOIN cx ON cx.run_id = cc.run_id AND cx.path = cc.path)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _arrows(column: str) -> str:
    return f"coalesce(array_to_string({column}, '→'), NULL) AS {column}"


_WHY = f"SELECT run_id, at, task, outcome, {_arrows('chain')}, {_arrows('cycle')}, root FROM wy"
_CIRCLES = f"SELECT run_id, at, {_arrows('members')}, {_arrows('cycle')}, {_arrows('resources')} FROM de"


def _lint(long_poll: int, long_park: int) -> str:
    return f"""SELECT run_id, at, 0 AS severity, 'deadlock' AS kind, NULL::BIGINT AS task, NULL::BIGINT AS resource, NULL AS op, len(members) AS n, 9223372036854775807 AS magnitude, array_to_string(members, '→') AS members FROM de
UNION ALL SELECT po.run_id, at, 1, 'long_poll', task, NULL, NULL, count(*), max(least(coalesce(end_ts, at), at) - start_ts), NULL FROM po JOIN en USING (run_id)
  WHERE least(coalesce(end_ts, at), at) - start_ts > {long_poll} AND NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = po.run_id AND t.id = task AND kind = 'blocking') GROUP BY po.run_id, at, task
UNION ALL SELECT pe.run_id, en.at, 1, 'long_park', task, resource, op_name, count(*), max(dur), NULL FROM pe JOIN en USING (run_id) WHERE dur > {long_park} AND NOT EXISTS (SELECT 1 FROM ti WHERE ti.run_id = pe.run_id AND ti.id = pe.resource)
  AND NOT EXISTS (SELECT 1 FROM de WHERE de.run_id = pe.run_id AND list_contains(members, task)) GROUP BY pe.run_id, en.at, task, resource, op_name
UNION ALL SELECT fc.run_id, at, 1, 'saturated_channel', NULL, resource, NULL, capacity, max_depth, NULL FROM fc JOIN en USING (run_id) WHERE max_depth >= capacity"""


_B = [_ONE, _BOUNDS]
_WORLD = [*_B, _GRID, _STATUS, _HOLDER]
_RING_END = [_RING, _BOUNDS, _END, _NO_PARENT, _HOLDER, _LINKS, _WALK, _DEAD]
_RG = f"""wv AS (SELECT run_id, resource, CAST(sum(total) AS BIGINT) AS w, count(*) AS n FROM mw GROUP BY ALL),
rg AS (SELECT rk.run_id, key, count(*) AS instances, CAST(coalesce(sum(w), 0) AS BIGINT) AS wait_ns, CAST(coalesce(sum(n), 0) AS BIGINT) AS waiters, max(capacity) AS capacity, max(max_depth) AS max_depth
  FROM rk LEFT JOIN wv ON wv.run_id = rk.run_id AND wv.resource = rk.id LEFT JOIN fc ON fc.run_id = rk.run_id AND fc.resource = rk.id
  WHERE concrete_type IS NULL OR concrete_type NOT IN ('Sleep', 'Interval', 'Timeout') GROUP BY rk.run_id, key)"""
_MEANS = """jn AS (SELECT key, b.instances AS bi, b.poll_ns AS bp, b.wait_ns AS bw, c.instances AS ci, c.poll_ns AS cp2, c.wait_ns AS cw FROM (SELECT * FROM tg WHERE run_id = 'base') b FULL JOIN (SELECT * FROM tg WHERE run_id = 'cur') c USING (key)),
me AS (SELECT key, 'poll' AS what, bp // bi AS b, cp2 // ci AS c FROM jn WHERE bi IS NOT NULL AND ci IS NOT NULL UNION ALL SELECT key, 'wait', bw // bi, cw // ci FROM jn WHERE bi IS NOT NULL AND ci IS NOT NULL)"""

_DEAD_KEYS = """du AS (SELECT run_id, members, unnest(members) AS x FROM de),
dn AS (SELECT du.run_id, members, list(coalesce(k0, concat('<unnamed ', coalesce(kd, 'task'), '>'))) AS names FROM du LEFT JOIN tk ON tk.run_id = du.run_id AND tk.id = x GROUP BY du.run_id, members),
dq AS (SELECT DISTINCT run_id, array_to_string(list_sort(names), '→') AS key FROM dn)"""

SQL = {
    "bounds": _with(*_B) + "SELECT * FROM bo",
    "task_status": _with(*_B, _GRID, _STATUS) + "SELECT run_id, at, task, state, CASE WHEN state = 'parked' THEN parked_on END AS resource FROM ss",
    "resource_holder": _with(*_B, _GRID, _HOLDER) + "SELECT * FROM ho",
    "resource_permits": _with(*_B, _GRID, _PERMITS) + "SELECT * FROM pm",
    "world_tasks": _with(*_B, _GRID, _STATUS) + "SELECT run_id, at, task, parent, state, CASE WHEN state = 'parked' THEN parked_on END AS resource FROM ss WHERE visible",
    "world_resources": _with(*_B, _GRID, _HOLDER, _PERMITS)
    + """SELECT gi.run_id, gi.at, r.id AS resource, holder, permits, capacity, capacity - permits AS depth, locked FROM gi JOIN r ON r.run_id = gi.run_id AND new_ts <= gi.at
    LEFT JOIN ho ON ho.run_id = gi.run_id AND ho.at = gi.at AND ho.resource = r.id LEFT JOIN pm ON pm.run_id = gi.run_id AND pm.at = gi.at AND pm.resource = r.id""",
    "channel_depths": _with(*_B, _DEPTHS) + "SELECT * FROM cd",
    "park_episodes": _with(*_B, _EPISODES) + "SELECT * FROM pe",
    "longest_parks": _with(*_B, _EPISODES) + "SELECT * FROM pe ORDER BY dur DESC, ts, id LIMIT 10",
    "hold_intervals": _with(*_B, _HOLDS) + "SELECT * FROM hd",
    "poll_percentiles": _with(_ONE, "ord AS (SELECT run_id, list(end_ts - start_ts ORDER BY end_ts - start_ts) AS d, count(*) AS n FROM po WHERE end_ts >= start_ts GROUP BY run_id)")
    + "SELECT run_id, n, " + ", ".join(f"d[CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) + 1] AS {name}" for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))) + " FROM ord",
    "run_stats": _with(*_B, "ord AS (SELECT run_id, list(end_ts - start_ts ORDER BY end_ts - start_ts) AS d, count(*) AS n FROM po WHERE end_ts >= start_ts GROUP BY run_id)")
    + "SELECT bo.run_id, max_ts - min_ts AS duration, (SELECT count(*) FROM t) AS tasks, (SELECT count(*) FROM r) AS resources, n AS polls, "
    + ", ".join(f"d[CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) + 1] AS {name}" for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))) + " FROM bo JOIN ord USING (run_id)",
    "wait_for": _with(*_WORLD, _LINKS) + "SELECT run_id, at, task, resource, op, since, wait_ns, holder FROM li",
    "why_blocked": _with(*_WORLD, _LINKS, _WALK) + _WHY,
    "ring_why_blocked": _with(*_RING_END) + _WHY,
    "deadlocks": _with(*_WORLD, _LINKS, _WALK, _DEAD) + _CIRCLES,
    "ring_deadlocks": _with(*_RING_END) + _CIRCLES,
    "pick_blocked": _with(*_WORLD, _LINKS)
    + """SELECT ss.run_id, ss.at, coalesce(arg_min(ss.task, (ss.spawn_ts, ss.task)) FILTER (holder IS NOT NULL AND holder <> ss.task), arg_min(ss.task, (ss.spawn_ts, ss.task)) FILTER (li.task IS NOT NULL), arg_max(ss.task, (ss.spawn_ts, ss.task))) AS task
    FROM ss LEFT JOIN li ON li.run_id = ss.run_id AND li.at = ss.at AND li.task = ss.task WHERE ss.visible GROUP BY ss.run_id, ss.at""",
    "latency_buckets": _with(*_B, _EPISODES, _GAPS)
    + """SELECT ws.run_id, ws.task, greatest(0, w1 - w0) AS total_ns, coalesce(own, 0) AS own_ns, coalesce(n, 0) AS polls, coalesce(re, 0) AS resource_ns, coalesce(tm, 0) AS timer_ns, coalesce(lg, 0) AS lag_ns, coalesce(idl, 0) AS idle_ns
    FROM ws LEFT JOIN (SELECT run_id, task, CAST(sum(e - s) AS BIGINT) AS own, count(*) AS n FROM cp WHERE e >= s GROUP BY ALL) o USING (run_id, task)
    LEFT JOIN (SELECT run_id, task, CAST(sum(wait_ns) FILTER (resource IS NOT NULL AND NOT timer) AS BIGINT) AS re, CAST(sum(wait_ns) FILTER (timer) AS BIGINT) AS tm, CAST(sum(lag_ns) AS BIGINT) AS lg,
      CAST(sum(wait_ns) FILTER (resource IS NULL) AS BIGINT) AS idl FROM gt GROUP BY ALL) g USING (run_id, task)""",
    "wait_episodes": _with(*_B, _EPISODES, _GAPS, _BLAMED) + "SELECT * FROM bw",
    "holder_activity": _with(*_B, _EPISODES, _GAPS, _BLAMED, "tw AS (SELECT * FROM bw WHERE holder IS NOT NULL ORDER BY wait_ns DESC, task, g0 LIMIT 20)")
    + """SELECT run_id, task, resource, op, since, g0, g1, wait_ns, lag_ns, holder,
    coalesce((SELECT CAST(sum(least(coalesce(end_ts, g1 - lag_ns), g1 - lag_ns) - greatest(start_ts, g0)) AS BIGINT) FROM po WHERE po.run_id = tw.run_id AND po.task = tw.holder AND start_ts <= g1 - lag_ns AND (end_ts IS NULL OR end_ts >= g0)
      AND least(coalesce(end_ts, g1 - lag_ns), g1 - lag_ns) >= greatest(start_ts, g0)), 0) AS polling_ns,
    coalesce((SELECT CAST(sum(greatest(0, least(ts + dur, g1 - lag_ns) - greatest(ts, g0))) AS BIGINT) FROM pe WHERE pe.run_id = tw.run_id AND pe.task = tw.holder), 0) AS parked_ns,
    (SELECT arg_max(pe.resource, (least(ts + dur, g1 - lag_ns) - greatest(ts, g0), -ts, -id)) FROM pe WHERE pe.run_id = tw.run_id AND pe.task = tw.holder AND least(ts + dur, g1 - lag_ns) > greatest(ts, g0)) AS parked_on FROM tw""",
    "holder_activity_all": _with(*_B, _EPISODES, _GAPS, _BLAMED, "tw AS (SELECT * FROM bw WHERE holder IS NOT NULL)")
    + """SELECT run_id, task, resource, op, since, g0, g1, wait_ns, lag_ns, holder,
    coalesce((SELECT CAST(sum(least(coalesce(end_ts, g1 - lag_ns), g1 - lag_ns) - greatest(start_ts, g0)) AS BIGINT) FROM po WHERE po.run_id = tw.run_id AND po.task = tw.holder AND start_ts <= g1 - lag_ns AND (end_ts IS NULL OR end_ts >= g0)
      AND least(coalesce(end_ts, g1 - lag_ns), g1 - lag_ns) >= greatest(start_ts, g0)), 0) AS polling_ns,
    coalesce((SELECT CAST(sum(greatest(0, least(ts + dur, g1 - lag_ns) - greatest(ts, g0))) AS BIGINT) FROM pe WHERE pe.run_id = tw.run_id AND pe.task = tw.holder), 0) AS parked_ns,
    (SELECT arg_max(pe.resource, (least(ts + dur, g1 - lag_ns) - greatest(ts, g0), -ts, -id)) FROM pe WHERE pe.run_id = tw.run_id AND pe.task = tw.holder AND least(ts + dur, g1 - lag_ns) > greatest(ts, g0)) AS parked_on FROM tw""",
    "pick_slow": _with(*_B, _EPISODES) + "SELECT run_id, arg_max(task, (d, -task)) AS task FROM (SELECT run_id, task, sum(dur) AS d FROM pe GROUP BY ALL) GROUP BY run_id",
    "lint_findings": _with(*_B, _END, _STATUS, _HOLDER, _LINKS, _WALK, _DEAD, _EPISODES, _DEPTHS) + _lint(1_000_000, 1_000_000_000),
    "ring_lint": _with(*_RING_END, _EPISODES, _DEPTHS) + _lint(1, 100_000),
    "lock_order_edges": _with(*_B, _EPISODES, _HOLDS, _EDGES) + "SELECT * FROM eg",
    "lock_cycles": _with(*_B, _EPISODES, _HOLDS, _EDGES, _cycles(4)) + "SELECT run_id, array_to_string(path, '→') AS path FROM cc",
    "predicted": _with(*_B, _END, _STATUS, _HOLDER, _LINKS, _WALK, _DEAD, _EPISODES, _HOLDS, _EDGES, _cycles(4), _CHOSEN)
    + "SELECT run_id, array_to_string(path, '→') AS path, coalesce(array_to_string(tasks, '→'), '') AS tasks, coalesce(array_to_string(times, '→'), '') AS times, outcome, CAST(observed AS INT) AS observed FROM ch",
    "ring_predict": _with(*_RING_END, _EPISODES, _HOLDS, _EDGES, _cycles(5), _CHOSEN)
    + """SELECT run_id, array_to_string(path, '→') AS path, CAST(observed AS INT) AS observed, no FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY observed DESC, len(path), list_min(times), path) AS no FROM ch WHERE outcome = 'valid') WHERE no <= 16""",
    "interval_merge": _with(*_B, _EPISODES, _merged("task")) + "SELECT * FROM mw",
    "task_groups": _with(_PAIR, _BOUNDS, _EPISODES, _merged("task"), _LABELS, _TASK_GROUPS) + "SELECT * FROM tg",
    "resource_groups": _with(_PAIR, _BOUNDS, _EPISODES, _merged("resource, task"), _LABELS, _DEPTHS, _RG) + "SELECT * FROM rg",
    "diff_findings": _with(_PAIR, _BOUNDS, _EPISODES, _merged("task"), _LABELS, _TASK_GROUPS, _MEANS, _DEPTHS, _merged("resource, task", "2"), _RG.replace("FROM mw", "FROM mw2"), _END, _NO_PARENT, _HOLDER, _LINKS, _WALK, _DEAD, _DEAD_KEYS)
    + """SELECT 1 AS severity, what || '_regression' AS kind, key, b AS base_ns, c AS cur_ns FROM me WHERE c - b > 1000000 AND c > b * 1.5
    UNION ALL SELECT 2, what || '_improvement', key, b, c FROM me WHERE b - c > 1000000 AND b > c * 1.5
    UNION ALL SELECT 2, 'new_group', key, NULL, cp2 + cw FROM jn WHERE bi IS NULL AND cp2 + cw > 1000000
    UNION ALL SELECT 2, 'removed_group', key, bp + bw, NULL FROM jn WHERE ci IS NULL AND bp + bw > 1000000
    UNION ALL SELECT 1, 'new_saturation', key, capacity, max_depth FROM rg c WHERE run_id = 'cur' AND max_depth >= capacity AND NOT EXISTS (SELECT 1 FROM rg b WHERE b.run_id = 'base' AND b.key = c.key AND b.max_depth >= b.capacity)
    UNION ALL SELECT 0, 'new_deadlock', key, NULL, NULL FROM dq c WHERE run_id = 'cur' AND NOT EXISTS (SELECT 1 FROM dq b WHERE b.run_id = 'base' AND b.key = c.key)
    UNION ALL SELECT 2, 'fixed_deadlock', key, NULL, NULL FROM dq b WHERE run_id = 'base' AND NOT EXISTS (SELECT 1 FROM dq c WHERE c.run_id = 'cur' AND b.key = c.key)""",
    "spawn_tree": _with(_ONE, _LABELS, """tp AS (SELECT run_id, id, CASE WHEN parent <> id THEN parent END AS parent, printf('%020d.%020d', spawn_ts, id) AS step FROM t),
tt AS (SELECT run_id, id, 0::BIGINT AS depth, CAST(id AS VARCHAR) AS path, step AS place FROM tp WHERE parent IS NULL OR parent NOT IN (SELECT id FROM tp)
  UNION ALL SELECT tp.run_id, tp.id, depth + 1, path || '/' || tp.id, place || '/' || step FROM tt JOIN tp ON tp.parent = tt.id)""")
    + "SELECT tk.run_id, tk.id AS task, depth, path, coalesce(k0, concat(kd, '#', tk.id)) AS label, place FROM tk LEFT JOIN tt USING (run_id, id)",
    "hunt_cycles": _with(*_RING_END, _EPISODES, _HOLDS, _EDGES, _cycles(4), _CHOSEN)
    + """, best AS (SELECT * FROM (SELECT run_id, path, observed, row_number() OVER (PARTITION BY run_id ORDER BY observed DESC, len(path), list_min(times), path) AS no FROM ch WHERE outcome = 'valid') WHERE no <= 16),
sg AS (SELECT run_id, true AS seen, resources AS locks FROM de UNION ALL SELECT run_id, observed, path FROM best),
lb AS (SELECT run_id, seen, locks, unnest(locks) AS x FROM sg),
lk AS (SELECT DISTINCT run_id, seen, key FROM (SELECT lb.run_id, seen, locks, array_to_string(list_sort(list_distinct(list(concat(concrete_type, '@ring.rs:', loc_line)))), '→') AS key FROM lb JOIN r ON r.run_id = lb.run_id AND r.id = x GROUP BY ALL))
SELECT key, count(*) FILTER (seen) AS observed, count(*) FILTER (NOT seen) AS predicted, coalesce(string_agg(run_id, ',' ORDER BY run_id) FILTER (seen), '') AS observed_runs,
    coalesce(string_agg(run_id, ',' ORDER BY run_id) FILTER (NOT seen), '') AS predicted_runs, min(run_id) AS first_run FROM lk GROUP BY key""",
    "run_summary": _with(_PAIR, _BOUNDS, _EPISODES, _merged("task"), _LABELS, _TASK_GROUPS, _END, _NO_PARENT, _HOLDER, _LINKS, _WALK, _DEAD, _DEAD_KEYS)
    + """SELECT bo.run_id, max_ts - min_ts AS duration, CAST(sum(instances) AS BIGINT) AS tasks, (SELECT count(*) FROM r WHERE r.run_id = bo.run_id) AS resources, CAST(sum(poll_ns) AS BIGINT) AS poll_ns, CAST(sum(wait_ns) AS BIGINT) AS wait_ns,
    (SELECT count(*) FROM dq WHERE dq.run_id = bo.run_id) AS deadlocks FROM bo JOIN tg USING (run_id) GROUP BY ALL""",
}


def sql() -> dict[str, str]:
    # the engine has a keyword of that name
    return {name: re.sub(r"\bat\b", '"at"', text) for name, text in SQL.items()}
