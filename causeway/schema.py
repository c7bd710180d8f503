"""Schemas of a recording: the event log, and the six tables made of it."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LONG, INT, TEXT, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

#: One row per frame; each event fills the columns it has.
EVENTS = _schema(
    ("run_id", TEXT), ("seq", LONG), ("ts", LONG), ("ev", TEXT), ("id", LONG), ("parent", LONG), ("name", TEXT), ("kind", TEXT), ("concrete_type", TEXT),
    ("loc_file", TEXT), ("loc_line", INT), ("is_internal", BOOL), ("task", LONG), ("resource", LONG), ("op_name", TEXT), ("woken", LONG), ("by", LONG),
    ("field", TEXT), ("value", LONG), ("op", TEXT),
)
TABLES = {
    "tasks": _schema(("run_id", TEXT), ("id", LONG), ("parent", LONG), ("name", TEXT), ("kind", TEXT), ("loc_file", TEXT), ("loc_line", INT), ("spawn_ts", LONG), ("end_ts", LONG)),
    "resources": _schema(("run_id", TEXT), ("id", LONG), ("parent", LONG), ("concrete_type", TEXT), ("loc_file", TEXT), ("loc_line", INT), ("is_internal", BOOL), ("new_ts", LONG), ("drop_ts", LONG)),
    "polls": _schema(("run_id", TEXT), ("id", LONG), ("task", LONG), ("start_ts", LONG), ("end_ts", LONG)),
    "parks": _schema(("run_id", TEXT), ("id", LONG), ("task", LONG), ("resource", LONG), ("op_name", TEXT), ("ts", LONG)),
    "wakes": _schema(("run_id", TEXT), ("id", LONG), ("woken", LONG), ("by", LONG), ("ts", LONG)),
    "resource_state": _schema(("run_id", TEXT), ("id", LONG), ("resource", LONG), ("field", TEXT), ("value", LONG), ("op", TEXT), ("ts", LONG)),
}
#: Kinds of events, in the order in which their frames are numbered.
EVENT_KINDS = ("task_spawn", "poll_start", "poll_end", "park", "wake", "resource_new", "resource_state", "task_end", "resource_drop")
#: Resource types that are timers, and the names of task kinds and state operations.
TIMERS = ("Sleep", "Interval", "Timeout")
TASK_KINDS = ("task", "blocking", "block_on", "other")
STATE_OPS = ("override", "add", "sub")
HOLDER_FIELD = "acquired_by"
