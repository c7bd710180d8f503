"""What changed between two runs: groups of tasks and resources by stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.labels import is_timer, resource_key, task_key
from causeway.operators.intervals import busy_periods
from causeway.plans.folds import bounds, ends_of, park_episodes, without_timers
from causeway.plans.lint import ERROR, INFO, WARNING, circles
from causeway.plans.stats import full_channels
from causeway.recording import Recording
from causeway.scratch import Scratch

RATIO = 1.5
FLOOR_NS = 1_000_000


def merged_waits(rec: Recording, until: DataFrame, *keys: str) -> DataFrame:
    """(run_id, keys..., total, longest): length of the union of park episodes without timers, and of its longest stretch.

    Touching episodes belong together.
    """
    waits = without_timers(park_episodes(rec, until), rec)
    named = waits.select(F.struct("run_id", *keys).alias("entity"), "id", F.col("ts").alias("start_ts"), (F.col("ts") + F.col("dur")).alias("end_ts"))
    # ids are unique within a run only
    named = named.withColumn("id", F.struct("entity.run_id", "id"))
    spans = busy_periods(named, "entity", "id", rec.total("parks"))
    length = F.col("end_ts") - F.col("start_ts")
    return spans.groupBy("entity").agg(F.sum(length).alias("total"), F.max(length).alias("longest")).select("entity.*", "total", "longest")


def task_groups(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, key, instances, poll_ns, max_poll_ns, wait_ns, max_wait_ns) of known tasks by name, place or kind."""
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    polls = rec.polls.join(F.broadcast(until), "run_id").filter("start_ts <= at")
    took = F.greatest(F.lit(0), F.least("end_ts", "at") - F.col("start_ts"))
    polled = polls.groupBy("run_id", "task").agg(F.sum(took).alias("p"), F.max(took).alias("pm"))
    waited = merged_waits(rec, until, "task").select("run_id", "task", F.col("total").alias("w"), F.col("longest").alias("wm"))
    named = rec.tasks.select("run_id", F.col("id").alias("task"), task_key(F.col("name"), F.col("kind"), F.col("loc_file"), F.col("loc_line")).alias("key"))
    full = named.join(polled, ["run_id", "task"], "left").join(waited, ["run_id", "task"], "left").na.fill(0, ["p", "pm", "w", "wm"])
    return full.groupBy("run_id", "key").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("p").alias("poll_ns"), F.max("pm").alias("max_poll_ns"), F.sum("w").alias("wait_ns"), F.max("wm").alias("max_wait_ns")
    )


def resource_groups(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, key, instances, wait_ns, waiters, capacity, max_depth) of known resources but timers."""
    waits = merged_waits(rec, until, "resource", "task").groupBy("run_id", "resource").agg(F.sum("total").alias("w"), F.count(F.lit(1)).alias("n"))
    named = rec.resources.filter(~is_timer(F.col("concrete_type"))).select("run_id", F.col("id").alias("resource"), resource_key(F.col("concrete_type"), F.col("loc_file"), F.col("loc_line")).alias("key"))
    full = named.join(waits, ["run_id", "resource"], "left").join(full_channels(rec).drop("new_ts"), ["run_id", "resource"], "left").na.fill(0, ["w", "n"])
    return full.groupBy("run_id", "key").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("w").alias("wait_ns"), F.sum("n").alias("waiters"), F.max("capacity").alias("capacity"), F.max("max_depth").alias("max_depth")
    )


def run_summary(rec: Recording, scratch: Scratch) -> DataFrame:
    """(run_id, duration, tasks, resources, poll_ns, wait_ns, deadlocks) of each run."""
    ends = scratch.keep(ends_of(rec))
    groups = task_groups(rec, ends).groupBy("run_id").agg(F.sum("instances").alias("tasks"), F.sum("poll_ns").alias("poll_ns"), F.sum("wait_ns").alias("wait_ns"))
    made = rec.resources.groupBy("run_id").agg(F.count(F.lit(1)).alias("resources"))
    dead = deadlock_keys(rec, ends, scratch).groupBy("run_id").agg(F.count(F.lit(1)).alias("deadlocks"))
    spans = bounds(rec).select("run_id", F.greatest(F.lit(0), F.col("max_ts") - F.col("min_ts")).alias("duration"))
    full = spans.join(groups, "run_id", "left").join(made, "run_id", "left").join(dead, "run_id", "left").na.fill(0)
    return full.select("run_id", "duration", "tasks", "resources", "poll_ns", "wait_ns", "deadlocks")


def deadlock_keys(rec: Recording, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(run_id, key): the sorted task keys of each deadlock, joined, once."""
    inner = circles(rec, ends, scratch).select("run_id", "members", F.explode("members").alias("task"))
    named = rec.tasks.select("run_id", F.col("id").alias("task"), task_key(F.col("name"), F.col("kind"), F.col("loc_file"), F.col("loc_line")).alias("_key"))
    keyed = inner.join(named, ["run_id", "task"], "left").withColumn("_key", F.coalesce("_key", F.lit("<unnamed task>")))
    return keyed.groupBy("run_id", "members").agg(F.array_join(F.array_sort(F.collect_list("_key")), "→").alias("key")).select("run_id", "key").distinct()


def diff(rec: Recording, scratch: Scratch, base: str, cur: str, *, ratio: float = RATIO, floor_ns: int = FLOOR_NS) -> DataFrame:
    """(severity, kind, key, base_ns, cur_ns): findings on run ``cur`` against run ``base`` of one recording set.

    Means are whole numbers. A mean regressed if it grew by more than ``floor_ns`` and to more than
    ``ratio`` times; improvements are regressions the other way round. Groups that are new or gone
    count if they did more than ``floor_ns``. Values of a saturation are its capacity and depth.
    """
    ends = scratch.keep(ends_of(rec))

    def both(df: DataFrame) -> DataFrame:
        side = lambda run, mark: df.filter(F.col("run_id") == run).drop("run_id").select("key", F.struct(*[c for c in df.columns if c not in ("run_id", "key")]).alias(mark))
        return side(base, "b").join(side(cur, "c"), "key", "full_outer")

    tasks = both(scratch.keep(task_groups(rec, ends)))

    def grew(a: Column, b: Column) -> Column:
        return (F.greatest(F.lit(0), b - a) > floor_ns) & (b > a * ratio)

    out = []
    for what, column in (("poll", "poll_ns"), ("wait", "wait_ns")):
        mean = lambda s: F.expr(f"{s}.{column} div {s}.instances")  # noqa: B023, E731
        b, c = mean("b"), mean("c")
        found = F.when(grew(b, c), F.struct(F.lit(WARNING).alias("severity"), F.lit(f"{what}_regression").alias("kind"))).when(
            grew(c, b), F.struct(F.lit(INFO).alias("severity"), F.lit(f"{what}_improvement").alias("kind"))
        )
        out.append(tasks.filter("b is not null and c is not null").select(found.alias("_f"), "key", b.alias("base_ns"), c.alias("cur_ns")))
    none = F.lit(None).cast("bigint")
    mark = lambda severity, kind: F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind")).alias("_f")
    did = lambda s: F.col(f"{s}.poll_ns") + F.col(f"{s}.wait_ns")
    out.append(tasks.filter("b is null").filter(did("c") > floor_ns).select(mark(INFO, "new_group"), "key", none.alias("base_ns"), did("c").alias("cur_ns")))
    out.append(tasks.filter("c is null").filter(did("b") > floor_ns).select(mark(INFO, "removed_group"), "key", did("b").alias("base_ns"), none.alias("cur_ns")))
    full = lambda s: F.coalesce(F.col(f"{s}.max_depth") >= F.col(f"{s}.capacity"), F.lit(False))
    resources = both(resource_groups(rec, ends))
    out.append(resources.filter(full("c") & ~full("b")).select(mark(WARNING, "new_saturation"), "key", F.col("c.capacity").alias("base_ns"), F.col("c.max_depth").alias("cur_ns")))
    dead = scratch.keep(deadlock_keys(rec, ends, scratch))
    of = lambda run: dead.filter(F.col("run_id") == run).select("key")
    out.append(of(cur).join(of(base), "key", "left_anti").select(mark(ERROR, "new_deadlock"), "key", none.alias("base_ns"), none.alias("cur_ns")))
    out.append(of(base).join(of(cur), "key", "left_anti").select(mark(INFO, "fixed_deadlock"), "key", none.alias("base_ns"), none.alias("cur_ns")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.filter("_f is not null").select("_f.severity", "_f.kind", "key", "base_ns", "cur_ns")
