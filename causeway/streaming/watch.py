"""Live alerts over a growing log: deadlocks once per set of tasks, stuck tasks once per wait.

Each micro-batch is appended to the log so far, and the whole log is folded at its end again, so
late rows count where they belong, as in batch; only new alerts come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans.blocked import chains, deadlocks, wait_for, why_blocked
from causeway.plans.folds import ends_of, without_timers
from causeway.recording import from_log
from causeway.schema import EVENTS
from causeway.scratch import Scratch

STUCK_NS = 1_000_000_000
ALERTS = "run_id string, kind string, key string, task bigint, resource bigint, wait_ns bigint"


def alerts(log: DataFrame, scratch: Scratch, stuck_ns: int = STUCK_NS) -> DataFrame:
    """(run_id, kind, key, task, resource, wait_ns) at the end of each run of ``log``.

    ``deadlock`` for each set of tasks in a circle, ``stuck`` for each other task that waits for at
    least ``stuck_ns`` for something but a timer. ``key`` tells alerts apart.
    """
    rec = from_log(log)
    links = scratch.keep(wait_for(rec, ends_of(rec)))
    blocked = scratch.keep(why_blocked(chains(links, scratch, rec.total("tasks"))))
    none = F.lit(None).cast("bigint")
    caught = blocked.filter("outcome = 'deadlock'").select("run_id", "task")
    circles = deadlocks(blocked, links).select("run_id", F.lit("deadlock").alias("kind"), F.array_join("members", ",").alias("key"), none.alias("task"), none.alias("resource"), none.alias("wait_ns"))
    stuck = without_timers(links.filter(F.col("wait_ns") >= stuck_ns), rec).join(caught, ["run_id", "task"], "left_anti")
    return circles.unionByName(stuck.select("run_id", F.lit("stuck").alias("kind"), F.concat_ws(",", "task", "resource", "since").alias("key"), "task", "resource", "wait_ns"))


class Watcher:
    """Folds a log batch by batch; tick() gives the alerts not given before."""

    def __init__(self, spark: SparkSession, stuck_ns: int = STUCK_NS):
        self.spark, self.stuck_ns, self.scratch = spark, stuck_ns, Scratch(spark)
        self.batches: dict[int, DataFrame] = {}
        self.given = spark.createDataFrame([], ALERTS)
        self.codes = [0]

    def tick(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """``number`` is the batch's own: one that comes again replaces itself."""
        self.batches[len(self.batches) if number is None else number] = self.scratch.keep(batch.select(*EVENTS.fieldNames()))
        log = None
        for part in self.batches.values():
            log = part if log is None else log.unionByName(part)
        fresh = alerts(log, self.scratch, self.stuck_ns).join(self.given.select("run_id", "kind", "key"), ["run_id", "kind", "key"], "left_anti")
        fresh = self.scratch.keep(fresh)
        self.given = self.given.unionByName(fresh)
        return fresh

    def exit_code(self) -> int:
        """2 after any deadlock, 1 after any stuck task, else 0."""
        worst = self.given.agg(F.max(F.when(F.col("kind") == "deadlock", 2).otherwise(1))).first()[0]
        return worst or 0


def watch(stream: DataFrame, sink: Callable[[DataFrame], None], stuck_ns: int = STUCK_NS, interval: str = "500 milliseconds"):
    """Starts the streaming query; ``sink`` gets each batch's new alerts. Stop it with query.stop()."""
    watcher = Watcher(stream.sparkSession, stuck_ns)
    query = stream.writeStream.trigger(processingTime=interval).foreachBatch(lambda df, number: sink(watcher.tick(df, number))).start()
    return query, watcher
