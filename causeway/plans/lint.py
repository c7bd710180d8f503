"""Findings worth a look: deadlocks, long polls, long parks, full channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.blocked import chains, deadlocks, wait_for, why_blocked
from causeway.plans.folds import AT, park_episodes, without_timers
from causeway.plans.stats import full_channels
from causeway.recording import Recording
from causeway.scratch import Scratch

LONG_POLL_NS = 1_000_000
LONG_PARK_NS = 1_000_000_000
ERROR, WARNING, INFO = 0, 1, 2
_COLUMNS = [*AT, "severity", "kind", "task", "resource", "op", "n", "magnitude", "members"]


def circles(rec: Recording, instants: DataFrame, scratch: Scratch) -> DataFrame:
    """The deadlock cycles at the given instants."""
    links = scratch.keep(wait_for(rec, instants))
    return deadlocks(why_blocked(chains(links, scratch, rec.total("tasks"))), links)


def long_polls(rec: Recording, instants: DataFrame, least_ns: int = LONG_POLL_NS) -> DataFrame:
    """(run_id, at, task, n, max_ns): polls longer than ``least_ns``, ended or running until ``at``; tasks of kind blocking are exempt."""
    polls = rec.polls.join(F.broadcast(instants), "run_id")
    done = F.col("end_ts").isNotNull() & (F.col("end_ts") <= F.col("at"))
    took = F.when(done, F.col("end_ts") - F.col("start_ts")).when(F.col("start_ts") <= F.col("at"), F.col("at") - F.col("start_ts"))
    long = polls.withColumn("_took", took).filter(F.col("_took") > least_ns).groupBy(*AT, "task").agg(F.count(F.lit(1)).alias("n"), F.max("_took").alias("max_ns"))
    exempt = rec.tasks.filter("kind = 'blocking'").select("run_id", F.col("id").alias("task"))
    return long.join(exempt, ["run_id", "task"], "left_anti")


def long_parks(rec: Recording, instants: DataFrame, caught: DataFrame, least_ns: int = LONG_PARK_NS) -> DataFrame:
    """(run_id, at, task, resource, op, n, max_ns): parks longer than ``least_ns``; timers and the ``caught`` tasks of deadlocks are exempt."""
    long = without_timers(park_episodes(rec, instants).filter(F.col("dur") > least_ns), rec).join(caught, ["run_id", "task"], "left_anti")
    found = long.groupBy("run_id", "task", "resource", F.col("op_name").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.max("dur").alias("max_ns"))
    return found.join(F.broadcast(instants), "run_id")


def lint(rec: Recording, instants: DataFrame, scratch: Scratch, *, long_poll_ns: int = LONG_POLL_NS, long_park_ns: int = LONG_PARK_NS) -> DataFrame:
    """Findings of one instant per run: (run_id, at, severity, kind, task, resource, op, n, magnitude, members).

    Severity 0 are errors (deadlocks), 1 warnings. ``magnitude`` orders a severity's findings: ns, or
    the depth of a channel, which counts at any time. Thresholds are exceeded, not met.
    """
    found = scratch.keep(circles(rec, instants, scratch))
    caught = found.select("run_id", F.explode("members").alias("task")).distinct()
    text, none = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def finding(df: DataFrame, severity: int, kind: str, **columns) -> DataFrame:
        given = {"task": none, "resource": none, "op": text, "n": none, "magnitude": none, "members": text, **columns}
        return df.select(*AT, F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), *[c.alias(n) for n, c in given.items()])

    col = F.col
    parts = [
        finding(found, ERROR, "deadlock", n=F.size("members").cast("bigint"), magnitude=F.lit((1 << 63) - 1), members=F.array_join("members", "→")),
        finding(long_polls(rec, instants, long_poll_ns), WARNING, "long_poll", task=col("task"), n=col("n"), magnitude=col("max_ns")),
        finding(long_parks(rec, instants, caught, long_park_ns), WARNING, "long_park", task=col("task"), resource=col("resource"), op=col("op"), n=col("n"), magnitude=col("max_ns")),
        finding(
            full_channels(rec).filter("max_depth >= capacity").join(F.broadcast(instants), "run_id"), WARNING, "saturated_channel", resource=col("resource"), n=col("capacity"), magnitude=col("max_depth")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*_COLUMNS)


def exit_code(findings: DataFrame) -> int:
    """2 with any error, 1 with any finding, else 0."""
    worst = findings.agg(F.min("severity")).first()[0]
    return 0 if worst is None else 2 if worst == ERROR else 1
