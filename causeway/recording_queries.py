"""The registered queries on recordings: the test tables as one run, as a pair of runs, and the ring of locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans import blocked, diff, folds, hunt, latency, lint, predict, stats, tree
from causeway.recording import Recording, from_tables
from causeway.schema import TABLES
from causeway.scratch import Scratch
from causeway.sources.ring import ring_recording

#: Instants of a run at which states are asked for: thirds of its length.
GRID = 3


def _rec(spark: SparkSession, sf_dir: str) -> tuple[Recording, DataFrame, Scratch]:
    """The recording and the instants at its end."""
    rec, scratch = from_tables(spark, sf_dir), Scratch(spark)
    return rec, scratch.keep(folds.ends_of(rec)), scratch


def _grid(ends: DataFrame) -> DataFrame:
    return ends.select("run_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRID)), lambda g: F.floor(F.col("at") * g / GRID))).alias("at"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[Recording, Scratch]:
    """Two runs: the first half of the recording's time, and the second."""
    whole, ends, scratch = _rec(spark, sf_dir)
    middle = F.broadcast(ends.select("run_id", F.floor(F.col("at") / 2).alias("_mid")))
    tables = {}
    for name, schema in TABLES.items():
        df = whole.tables[name].join(middle, "run_id")
        if name in ("tasks", "resources"):
            since, until = ("spawn_ts", "end_ts") if name == "tasks" else ("new_ts", "drop_ts")
            first = df.filter(f"{since} < _mid").withColumn(until, F.when(F.col(until) < F.col("_mid"), F.col(until)))
            second = df.filter(f"{until} is null or {until} >= _mid")
        else:
            ts = "start_ts" if name == "polls" else "ts"
            first, second = df.filter(f"{ts} < _mid"), df.filter(f"{ts} >= _mid")
        both = first.withColumn("run_id", F.lit("base")).unionByName(second.withColumn("run_id", F.lit("cur")))
        tables[name] = both.select(*schema.fieldNames())
    return Recording(spark, tables, dict(whole.totals)), scratch


def _ring(spark: SparkSession, sf_dir: str) -> tuple[Recording, DataFrame, Scratch]:
    scratch = Scratch(spark)
    rec = ring_recording(spark, sf_dir, scratch)
    return rec, scratch.keep(folds.ends_of(rec)), scratch


def bounds(spark, sf_dir):
    return folds.bounds(_rec(spark, sf_dir)[0])


def task_status(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.task_status(rec, _grid(ends)).select("run_id", "at", "task", "state", "resource")


def resource_holder(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.resource_holder(rec, _grid(ends))


def resource_permits(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.resource_permits(rec, _grid(ends)).withColumn("locked", F.col("locked").cast("int"))


def world_tasks(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.world_tasks(rec, _grid(ends))


def world_resources(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.world_resources(rec, _grid(ends)).withColumn("locked", F.col("locked").cast("int"))


def channel_depths(spark, sf_dir):
    return folds.channel_depths(_rec(spark, sf_dir)[0])


def park_episodes(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.park_episodes(rec, ends)


def longest_parks(spark, sf_dir):
    return stats.longest_parks(_rec(spark, sf_dir)[0], 10)


def hold_intervals(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return folds.hold_intervals(rec, ends)


def poll_percentiles(spark, sf_dir):
    return stats.poll_percentiles(_rec(spark, sf_dir)[0])


def run_stats(spark, sf_dir):
    return stats.stats(_rec(spark, sf_dir)[0])


def wait_for(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return blocked.wait_for(rec, _grid(ends)).drop("spawn_ts", "visible")


def _why(rec: Recording, instants: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    links = scratch.keep(blocked.wait_for(rec, instants))
    return blocked.why_blocked(blocked.chains(links, scratch, rec.total("tasks"))), links


def _flat(found: DataFrame) -> DataFrame:
    return found.select("run_id", "at", "task", "outcome", F.array_join("chain", "→").alias("chain"), F.array_join("cycle", "→").alias("cycle"), "root")


def why_blocked(spark, sf_dir):
    rec, ends, scratch = _rec(spark, sf_dir)
    return _flat(_why(rec, _grid(ends), scratch)[0])


def ring_why_blocked(spark, sf_dir):
    return _flat(_why(*_ring(spark, sf_dir))[0])


def _circles(rec: Recording, instants: DataFrame, scratch: Scratch) -> DataFrame:
    return blocked.deadlocks(*_why(rec, instants, scratch)).select("run_id", "at", *[F.array_join(c, "→").alias(c) for c in ("members", "cycle", "resources")])


def deadlocks(spark, sf_dir):
    rec, ends, scratch = _rec(spark, sf_dir)
    return _circles(rec, _grid(ends), scratch)


def ring_deadlocks(spark, sf_dir):
    return _circles(*_ring(spark, sf_dir))


def pick_blocked(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    grid = _grid(ends)
    return blocked.pick_blocked(rec, grid, blocked.wait_for(rec, grid))


def latency_buckets(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return latency.latency_buckets(rec, ends)


def wait_episodes(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return latency.blamed_waits(rec, ends).drop("wake").withColumn("timer", F.col("timer").cast("int"))


def holder_activity(spark, sf_dir):
    """The longest blamed waits of all and what their holders did."""
    rec, ends, scratch = _rec(spark, sf_dir)
    waits = latency.blamed_waits(rec, ends).filter("holder is not null").orderBy(F.desc("wait_ns"), "task", "g0").limit(20)
    return latency.holder_activity(rec, scratch.keep(waits), ends, scratch)


def holder_activity_all(spark, sf_dir):
    """All blamed waits and what their holders did."""
    rec, ends, scratch = _rec(spark, sf_dir)
    # read many times: without its tables written once, the plan outgrows the driver
    rec = Recording(spark, {name: scratch.keep(df) for name, df in rec.tables.items()}, rec.totals)
    return latency.holder_activity(rec, latency.blamed_waits(rec, ends, scratch), ends, scratch)


def pick_slow(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return latency.pick_slow(rec, ends)


def lint_findings(spark, sf_dir):
    rec, ends, scratch = _rec(spark, sf_dir)
    return lint.lint(rec, ends, scratch)


def ring_lint(spark, sf_dir):
    return lint.lint(*_ring(spark, sf_dir), long_poll_ns=1, long_park_ns=100_000)


def lock_order_edges(spark, sf_dir):
    rec, ends, scratch = _rec(spark, sf_dir)
    return predict.order_edges(*predict.numbered(rec, ends, scratch))


def lock_cycles(spark, sf_dir):
    rec, ends, scratch = _rec(spark, sf_dir)
    return predict.simple_cycles(*predict.numbered(rec, ends, scratch), scratch).select("run_id", F.array_join("path", "→").alias("path"))


def predicted(spark, sf_dir):
    """All cycles looked at, with outcome."""
    rec, ends, scratch = _rec(spark, sf_dir)
    cycles, _ = predict.predicted_cycles(rec, ends, scratch)
    return cycles.select("run_id", *[F.array_join(c, "→").alias(c) for c in ("path", "tasks", "times")], "outcome", F.col("observed").cast("int").alias("observed"))


def ring_predict(spark, sf_dir):
    best, _ = predict.predict(*_ring(spark, sf_dir), max_len=5)
    return best.select("run_id", F.array_join("path", "→").alias("path"), F.col("observed").cast("int").alias("observed"), "no")


def interval_merge(spark, sf_dir):
    rec, ends, _ = _rec(spark, sf_dir)
    return diff.merged_waits(rec, ends, "task")


def task_groups(spark, sf_dir):
    rec, scratch = _pair(spark, sf_dir)
    return diff.task_groups(rec, scratch.keep(folds.ends_of(rec)))


def resource_groups(spark, sf_dir):
    rec, scratch = _pair(spark, sf_dir)
    return diff.resource_groups(rec, scratch.keep(folds.ends_of(rec)))


def run_summary(spark, sf_dir):
    rec, scratch = _pair(spark, sf_dir)
    return diff.run_summary(rec, scratch)


def diff_findings(spark, sf_dir):
    rec, scratch = _pair(spark, sf_dir)
    return diff.diff(rec, scratch, "base", "cur")


def spawn_tree(spark, sf_dir):
    rec, _, scratch = _rec(spark, sf_dir)
    return tree.spawn_tree(rec, scratch)


def hunt_cycles(spark, sf_dir):
    """The rings of five regions as five runs of one program."""
    rec, _, scratch = _ring(spark, sf_dir)
    return hunt.hunt_cycles(rec, scratch)


QUERIES = {
    q.__name__: q
    for q in (
        bounds, task_status, resource_holder, resource_permits, world_tasks, world_resources, channel_depths, park_episodes, longest_parks, hold_intervals, poll_percentiles, run_stats,
        wait_for, why_blocked, ring_why_blocked, deadlocks, ring_deadlocks, pick_blocked, latency_buckets, wait_episodes, holder_activity, holder_activity_all, pick_slow, lint_findings, ring_lint, lock_order_edges,
        lock_cycles, predicted, ring_predict, interval_merge, task_groups, resource_groups, run_summary, diff_findings, spawn_tree, hunt_cycles,
    )
}
