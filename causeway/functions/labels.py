"""Labels and stable keys of tasks and resources, and readable durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.schema import TIMERS


def _kind(kind: Column) -> Column:
    """The kind as it is printed: other kinds are tasks."""
    return F.when(kind.isNull() | (kind == "other"), "task").otherwise(kind)


def place(file: Column, line: Column) -> Column:
    """``file:line``, ``file``, or ``<unknown>`` if only the line is known; null if nothing is."""
    known = F.when(file.isNull(), "<unknown>").when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line))
    return F.when(file.isNotNull() | line.isNotNull(), known)


def task_label(name: Column, kind: Column, file: Column, line: Column, ident: Column) -> Column:
    return F.coalesce(name, F.concat(_kind(kind), F.lit("@"), place(file, line)), F.concat(_kind(kind), F.lit("#"), ident))


def task_key(name: Column, kind: Column, file: Column, line: Column) -> Column:
    """What names a task across runs."""
    return F.coalesce(name, F.concat(_kind(kind), F.lit("@"), place(file, line)), F.concat(F.lit("<unnamed "), _kind(kind), F.lit(">")))


def resource_label(kind: Column, file: Column, line: Column, ident: Column) -> Column:
    named = F.coalesce(kind, F.lit("?"))
    return F.coalesce(F.concat(named, F.lit("@"), place(file, line)), F.concat(named, F.lit("#"), ident))


def resource_key(kind: Column, file: Column, line: Column) -> Column:
    named = F.coalesce(kind, F.lit("?"))
    return F.coalesce(F.concat(named, F.lit("@"), place(file, line)), named)


def is_timer(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TIMERS), F.lit(False))


def duration(ns: Column) -> Column:
    """Nanoseconds as ``1.2ms``, ``3.4µs`` or ``56ns``."""
    return (
        F.when(ns >= 1_000_000, F.concat(F.format_number(ns / 1e6, "0.0"), F.lit("ms")))
        .when(ns >= 1_000, F.concat(F.format_number(ns / 1e3, "0.0"), F.lit("µs")))
        .otherwise(F.concat(ns, F.lit("ns")))
    )
