"""SQL for the llm queries that SQL can express."""

from __future__ import annotations

import math

from causeway.llm.queries import PERIOD_NS, QUANTILES, SKETCH_ERROR

_G = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
_TOOK = "(SELECT DISTINCT id, task, start_ts, end_ts - start_ts AS took FROM polls WHERE id IS NOT NULL AND end_ts IS NOT NULL)"


def _percentiles(scope: str, key: str) -> str:
    """The true value of each rank, answered by its bucket."""
    ranked = f"""SELECT {key} AS key, took, row_number() OVER (PARTITION BY {key} ORDER BY took) - 1 AS rank, count(*) OVER (PARTITION BY {key}) AS n FROM {_TOOK}"""
    size = f"2 / ({_G!r} + 1) * pow({_G!r}, ceil(ln(abs(took)::DOUBLE) / {math.log(_G)!r}))"
    return f"""SELECT '{scope}' AS scope, key, q, n, CASE WHEN abs(v) >= 1000 THEN round(v) ELSE round(v, 3) END AS value
    FROM (SELECT *, CAST(CASE WHEN took = 0 THEN 0 ELSE sign(took) * {size} END AS DOUBLE) AS v FROM ({ranked})) JOIN (SELECT unnest({QUANTILES}::DOUBLE[]) AS q) ON rank = CAST(floor(q * (n - 1)) AS BIGINT)"""


_ALL = _percentiles("all", "CAST(NULL AS BIGINT)")
_RUNS = r"""WITH k AS (SELECT *, lower(regexp_replace(regexp_replace(op_name, '#[0-9]+\s*$', ''), '[^A-Za-z0-9]', '', 'g')) AS plain
    FROM (SELECT DISTINCT id, task, resource, op_name, ts FROM parks) WHERE task IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, CASE WHEN lag(resource) OVER w = resource AND lag(plain) OVER w = plain THEN 0 ELSE 1 END AS opens FROM k WINDOW w AS (PARTITION BY task ORDER BY ts, id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY task ORDER BY ts, id) AS g FROM l),
r AS (SELECT task, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id, count(*) AS n, max(ts) - min(ts) AS duration FROM g GROUP BY task, g HAVING count(*) > 1)
"""

SQL = {
    "p2_percentiles": f"{_percentiles('task', 'task')} UNION ALL {_ALL}",
    "p2_periods": f"{_percentiles('period', f'start_ts - start_ts % {PERIOD_NS}')} UNION ALL {_ALL}",
    "p7_found": _RUNS + "SELECT task, first_id, last_id FROM r",
    "p7_runs": _RUNS + "SELECT task, first_id, last_id, n, duration FROM r",
}


def sql() -> dict[str, str]:
    return dict(SQL)
