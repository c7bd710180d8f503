"""SQL for the core's queries, written apart from the Spark forms: plain windows, joins and recursion."""

from __future__ import annotations

import os

import pyarrow.parquet as pq

_POLLS = "(SELECT DISTINCT id, task, start_ts, end_ts FROM polls WHERE id IS NOT NULL)"
_PARKS = "(SELECT DISTINCT id, task, resource, op_name, ts FROM parks WHERE id IS NOT NULL)"
_TASKS = "(SELECT id, max(parent) AS parent, min(spawn_ts) AS since, max(end_ts) AS until FROM tasks WHERE id IS NOT NULL GROUP BY id)"
_RESOURCES = "(SELECT id, max(parent) AS parent, min(new_ts) AS since, max(drop_ts) AS until FROM resources WHERE id IS NOT NULL GROUP BY id)"
_PLAIN = r"lower(regexp_replace(regexp_replace({0}, '#[0-9]+\s*$', ''), '[^A-Za-z0-9]', '', 'g'))"


def _one_kind(name: str, ref: str, ts: str, rows: str, parents: str) -> str:
    return f"""SELECT '{name}' AS table_name, '{ref}' AS ref_field, r.id AS row_id, r.{ts} AS ts,
      CASE WHEN p.id IS NULL THEN 'missing' WHEN r.{ts} > p.until THEN 'ended' WHEN r.{ts} < p.since THEN 'not_yet' END AS reason
    FROM {rows} r LEFT JOIN {parents} p ON p.id = r.{ref} WHERE r.{ref} IS NOT NULL"""


_REFERENCES = " UNION ALL ".join(
    (
        _one_kind("parks", "resource", "ts", _PARKS, _RESOURCES),
        _one_kind("parks", "task", "ts", _PARKS, _TASKS),
        _one_kind("polls", "task", "start_ts", _POLLS, _TASKS),
    )
)

_WALK = f"""WITH RECURSIVE nodes AS (SELECT 'tasks' AS grp, id, parent FROM {_TASKS} UNION ALL SELECT 'resources', id, parent FROM {_RESOURCES}),
tree AS (
  SELECT n.grp, n.id, n.id AS root, CAST(0 AS BIGINT) AS depth, CAST(n.id AS VARCHAR) AS path FROM nodes n
    WHERE n.parent IS NULL OR NOT EXISTS (SELECT 1 FROM nodes m WHERE m.grp = n.grp AND m.id = n.parent)
  UNION ALL SELECT n.grp, n.id, t.root, t.depth + 1, t.path || '/' || CAST(n.id AS VARCHAR) FROM tree t JOIN nodes n ON n.grp = t.grp AND n.parent = t.id),
lost AS (SELECT n.* FROM nodes n ANTI JOIN tree t ON t.grp = n.grp AND t.id = n.id),
walk AS (
  SELECT grp, id AS origin, parent AS nxt FROM lost
  UNION SELECT w.grp, w.origin, l.parent FROM walk w JOIN lost l ON l.grp = w.grp AND l.id = w.nxt),
stuck AS (SELECT grp, origin AS id, CASE WHEN bool_or(nxt = origin) THEN 'on_cycle' ELSE 'below_cycle' END AS node_state FROM walk GROUP BY grp, origin)
"""

_PERIODS = f"""WITH u AS (SELECT * FROM {_POLLS} WHERE task IS NOT NULL AND end_ts >= start_ts),
c AS (SELECT *, max(end_ts) OVER (PARTITION BY task ORDER BY start_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM u),
g AS (SELECT *, sum(CASE WHEN cover IS NULL OR start_ts > cover THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY start_ts, id) AS g FROM c),
p AS (SELECT task, g, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM g GROUP BY task, g),
b AS (SELECT *, lag(end_ts) OVER (PARTITION BY task ORDER BY g) AS free_since FROM p)
"""

_KINDS = f"""SELECT k.task, coalesce(c.op_name, 'other') AS kind, count(*) AS n, max(k.ts) AS last
  FROM (SELECT *, {_PLAIN.format("op_name")} AS plain FROM {_PARKS}) k LEFT JOIN (SELECT min(op_name) AS op_name, {_PLAIN.format("op_name")} AS plain FROM op_catalog GROUP BY 2) c USING (plain)
  GROUP BY 1, 2"""

SQL = {
    "p3_found": f"SELECT table_name, ref_field, row_id, reason FROM ({_REFERENCES}) WHERE reason IS NOT NULL",
    "p3_report": f"SELECT table_name, ref_field, reason, ts - ts % 60000000000 AS period_start, count(*) AS n FROM ({_REFERENCES}) WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_found": f"""SELECT 'polls' AS table_name, 'task' AS key_field, task AS key_value FROM {_POLLS} WHERE task IS NOT NULL GROUP BY task
      HAVING count(*) >= 0.02 * (SELECT count(*) FROM {_POLLS})
    UNION ALL SELECT 'parks', 'resource', resource FROM {_PARKS} WHERE resource IS NOT NULL GROUP BY resource HAVING count(*) >= 0.02 * (SELECT count(*) FROM {_PARKS})""",
    "p4_key_totals": f"""SELECT 'polls' AS table_name, 'task' AS key_field, task AS key_value, count(*) AS n,
        CAST(sum(CASE WHEN end_ts >= start_ts THEN end_ts - start_ts ELSE 0 END) AS BIGINT) AS total_ns, max(start_ts) AS last_ts FROM {_POLLS} GROUP BY task
    UNION ALL SELECT 'parks', 'resource', resource, count(*), 0, max(ts) FROM {_PARKS} GROUP BY resource""",
    "p4_order": f"SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY start_ts NULLS FIRST, id) AS pos FROM {_POLLS} WHERE task IS NOT NULL",
    "p4_order_all": f"""SELECT 'polls' AS table_name, 'task' AS key_field, id, task AS key_value, row_number() OVER (PARTITION BY task ORDER BY start_ts NULLS FIRST, id) AS pos FROM {_POLLS} WHERE task IS NOT NULL
    UNION ALL SELECT 'parks', 'resource', id, resource, row_number() OVER (PARTITION BY resource ORDER BY ts NULLS FIRST, id) FROM {_PARKS} WHERE resource IS NOT NULL""",
    "p5_found": _WALK + "SELECT grp AS table_name, id AS node_id, node_state FROM stuck",
    "p5_hierarchy": _WALK
    + """SELECT grp AS table_name, id AS node_id, root, depth, path, 'rooted' AS node_state FROM tree
    UNION ALL SELECT grp, id, NULL, NULL, NULL, node_state FROM stuck""",
    "p5_descendants": f"""WITH RECURSIVE nodes AS (SELECT 'tasks' AS grp, id, parent FROM {_TASKS} UNION ALL SELECT 'resources', id, parent FROM {_RESOURCES}),
tree AS (
  SELECT n.grp, n.id, [n.id] AS path FROM nodes n WHERE n.parent IS NULL OR NOT EXISTS (SELECT 1 FROM nodes m WHERE m.grp = n.grp AND m.id = n.parent)
  UNION ALL SELECT n.grp, n.id, list_append(t.path, n.id) FROM tree t JOIN nodes n ON n.grp = t.grp AND n.parent = t.id)
SELECT grp AS table_name, unnest(path[:-2]) AS ancestor, id AS node_id, unnest(range(len(path) - 1, 0, -1)) AS distance FROM tree""",
    # from each node below a circle upwards until a node of the circle
    "p5_descendants_all": _WALK
    + """, up AS (SELECT n.grp, n.parent AS ancestor, n.id, CAST(1 AS BIGINT) AS distance FROM nodes n WHERE n.parent IS NOT NULL
  AND EXISTS (SELECT 1 FROM nodes m WHERE m.grp = n.grp AND m.id = n.parent) AND NOT EXISTS (SELECT 1 FROM stuck s WHERE s.grp = n.grp AND s.id = n.id AND node_state = 'on_cycle')
  UNION ALL SELECT up.grp, n.parent, up.id, distance + 1 FROM up JOIN nodes n ON n.grp = up.grp AND n.id = up.ancestor JOIN nodes m ON m.grp = n.grp AND m.id = n.parent
    WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.grp = n.grp AND s.id = n.id AND node_state = 'on_cycle'))
SELECT grp AS table_name, ancestor, id AS node_id, distance FROM up""",
    "p6_found": _PERIODS
    + """SELECT task, 'period' AS span_kind, start_ts, end_ts FROM p WHERE n >= 2
    UNION ALL SELECT task, 'gap', free_since, start_ts FROM b WHERE start_ts - free_since BETWEEN 50000000 AND 20000000000""",
    "p6_periods": _PERIODS + "SELECT task, 'period' AS span_kind, start_ts, end_ts FROM p UNION ALL SELECT task, 'gap', free_since, start_ts FROM b WHERE free_since IS NOT NULL",
}


#: Folder of test tables with the fixed list of kinds, by which the columns of problem 1 are named.
SF_DIR = "/root/testdata/sf0.01"


def _features(path: str) -> dict[str, str]:
    """The wide row of problem 1: one filtered aggregate per kind and column."""
    if not os.path.exists(path):
        return {}
    names = sorted({n for n in pq.read_table(path, columns=["op_name"]).column(0).to_pylist() if n is not None})
    quoted = [(n.replace("'", "''"), n.replace('"', '""')) for n in [*names, "other"]]
    wide = ", ".join(f"""coalesce(CAST(sum(n) FILTER (kind = '{text}') AS BIGINT), 0) AS "n_{name}", max(last) FILTER (kind = '{text}') AS "last_{name}" """ for text, name in quoted)
    text = f"""WITH k AS ({_KINDS}), own AS (SELECT DISTINCT id FROM tasks WHERE id IS NOT NULL),
w AS (SELECT own.id, {wide} FROM own LEFT JOIN k ON k.task = own.id GROUP BY own.id),
s AS (SELECT task, count(*) AS n_spans, CAST(coalesce(sum(end_ts - start_ts) FILTER (end_ts >= start_ts), 0) AS BIGINT) AS span_time FROM {_POLLS} GROUP BY task)
SELECT w.*, coalesce(n_spans, 0) AS n_spans, coalesce(span_time, 0) AS span_time FROM w LEFT JOIN s ON s.task = w.id"""
    return {"p1_features": text}


def sql(sf_dir: str = SF_DIR) -> dict[str, str]:
    return {**_features(f"{sf_dir}/op_catalog.parquet"), **SQL}
