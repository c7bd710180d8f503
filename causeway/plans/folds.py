"""Folds over ordered state: bounds, status, holders, permits, episodes and holds at given instants.

``instants`` has (run_id, at), few rows per run; every result starts with them. Ties in time are
settled by the place in the log, the later row last. Hot tasks and resources are either combined
before the shuffle (status, holder, permits) or ordered in shards (episodes, holds, depths).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.labels import is_timer
from causeway.recording import Recording
from causeway.schema import HOLDER_FIELD
from causeway.scratch import Scratch
from causeway.skew import carry, shard_cuts

AT = ["run_id", "at"]


def bounds(rec: Recording) -> DataFrame:
    """(run_id, min_ts, max_ts): first time of spawns, news, polls, parks and states; last time of anything. Zeros for an empty table."""
    last = {
        "tasks": ["spawn_ts", "end_ts"], "resources": ["new_ts", "drop_ts"], "polls": ["start_ts", "end_ts"], "parks": ["ts"], "wakes": ["ts"], "resource_state": ["ts"],
    }
    first = {"tasks": "spawn_ts", "resources": "new_ts", "polls": "start_ts", "parks": "ts", "resource_state": "ts"}
    parts = [
        rec.tables[name].groupBy("run_id").agg(
            (F.min(first[name]) if name in first else F.lit(None).cast("bigint")).alias("lo"), reduce(F.greatest, [F.max(c) for c in columns]).alias("hi")
        )
        for name, columns in last.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("run_id").agg(F.coalesce(F.min("lo"), F.lit(0)).alias("min_ts"), F.coalesce(F.max("hi"), F.lit(0)).alias("max_ts"))


def ends_of(rec: Recording) -> DataFrame:
    """The instants at the end of each run."""
    return bounds(rec).select("run_id", F.col("max_ts").alias("at"))


def _at(df: DataFrame, instants: DataFrame) -> DataFrame:
    # a few rows per run, given by the caller
    return df.join(F.broadcast(instants), "run_id")


def task_status(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, task, state, resource): state ``done``, ``running``, ``parked`` (on resource) or ``idle``.

    Tasks that were spawned by then, or polled, or are declared at all; ``visible`` tells the first.
    Done once ended; running inside a poll; else parked if the last completed poll holds a park,
    on its latest one. Wakes don't count.
    """
    polls = _at(rec.polls, instants).filter("start_ts <= at")
    over = F.col("end_ts").isNotNull() & (F.col("end_ts") <= F.col("at"))
    per_task = polls.groupBy(*AT, "task").agg(
        F.max(~over).alias("_running"), F.max(F.when(over, F.struct("end_ts", "start_ts", "id"))).alias("_last")
    )
    last = per_task.filter("not _running and _last is not null").select(*AT, "task", F.col("_last.start_ts").alias("_a"), F.col("_last.end_ts").alias("_b"))
    within = _at(rec.parks, instants).join(last, [*AT, "task"]).filter("ts between _a and _b")
    parked = within.groupBy(*AT, "task").agg(F.max(F.struct("ts", "id", "resource")).alias("_park"))
    known = _at(rec.tasks.select("run_id", F.col("id").alias("task"), "spawn_ts", "end_ts"), instants)
    full = known.join(per_task.drop("_last"), [*AT, "task"], "full_outer").join(parked, [*AT, "task"], "left")
    state = (
        F.when(F.col("end_ts") <= F.col("at"), "done").when(F.coalesce("_running", F.lit(False)), "running").when(F.col("_park").isNotNull(), "parked").otherwise("idle")
    )
    return full.select(
        *AT, "task", state.alias("state"), F.when(state == "parked", F.col("_park.resource")).alias("resource"), F.coalesce(F.col("spawn_ts") <= F.col("at"), F.lit(False)).alias("visible"), "spawn_ts"
    )


def resource_holder(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, resource, holder): who last acquired a resource, if not unlocked since, dropped, or done itself."""
    rows = _at(rec.resource_state, instants).filter(f"ts <= at and (field = '{HOLDER_FIELD}' or (field = 'locked' and value = 0))")
    taken = F.when(F.col("field") == HOLDER_FIELD, F.col("value"))
    last = rows.groupBy(*AT, "resource").agg(F.max(F.struct("ts", "id", taken.alias("holder"))).alias("_last")).select(*AT, "resource", "_last.holder")
    held = last.filter("holder is not null")
    held = held.join(rec.resources.filter("drop_ts is not null").select("run_id", F.col("id").alias("resource"), "drop_ts"), ["run_id", "resource"], "left")
    held = held.join(rec.tasks.filter("end_ts is not null").select("run_id", F.col("id").alias("holder"), "end_ts"), ["run_id", "holder"], "left")
    return held.filter("(drop_ts is null or drop_ts > at) and (end_ts is null or end_ts > at)").select(*AT, "resource", "holder")


def resource_permits(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, resource, permits, capacity, locked) of resources with any such state.

    An override sets the permits, add and sub count from there, or from 0; capacity is the first
    override.
    """
    rows = _at(rec.resource_state.filter("field in ('permits', 'locked')"), instants).filter("ts <= at")
    sets = (F.col("field") == "permits") & ~F.coalesce(F.col("op").isin("add", "sub"), F.lit(False))
    place = lambda name: F.struct("ts", "id", F.col("value").alias(name))
    marks = rows.groupBy(*AT, "resource").agg(
        F.min(F.when(sets, place("v"))).alias("_first"),
        F.max(F.when(sets, place("v"))).alias("_base"),
        F.max(F.when(F.col("field") == "locked", place("v"))).alias("_locked"),
        F.max(F.when(F.col("field") == "permits", F.lit(True))).alias("_any"),
    )
    moves = rows.filter("field = 'permits' and op in ('add', 'sub')").join(marks.select(*AT, "resource", "_base"), [*AT, "resource"])
    moves = moves.filter("_base is null or ts > _base.ts or (ts = _base.ts and id > _base.id)")
    moved = moves.groupBy(*AT, "resource").agg(F.sum(F.when(F.col("op") == "add", F.col("value")).otherwise(-F.col("value"))).alias("_moved"))
    full = marks.join(moved, [*AT, "resource"], "left")
    zero = F.lit(0).cast("bigint")
    return full.select(
        *AT,
        "resource",
        F.when(F.col("_any"), F.coalesce("_base.v", zero) + F.coalesce("_moved", zero)).alias("permits"),
        F.col("_first.v").alias("capacity"),
        F.when(F.col("_locked").isNotNull(), F.col("_locked.v") != 0).alias("locked"),
    )


def world_tasks(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, task, parent, state, resource) of the tasks spawned by then."""
    visible = task_status(rec, instants).filter("visible").drop("visible", "spawn_ts")
    return visible.join(rec.tasks.select("run_id", F.col("id").alias("task"), "parent"), ["run_id", "task"]).select(*AT, "task", "parent", "state", "resource")


def world_resources(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, resource, holder, permits, capacity, depth, locked) of the resources made by then."""
    made = _at(rec.resources.select("run_id", F.col("id").alias("resource"), "new_ts"), instants).filter("new_ts <= at")
    full = made.join(resource_holder(rec, instants), [*AT, "resource"], "left").join(resource_permits(rec, instants), [*AT, "resource"], "left")
    return full.select(*AT, "resource", "holder", "permits", "capacity", (F.col("capacity") - F.col("permits")).alias("depth"), "locked")


def running_permits(rec: Recording) -> DataFrame:
    """(run_id, resource, ts, id, permits, sets): the permits after each change, and whether it set them.

    With m the moves summed up to a row, the permits are m plus (value - m) at the last override.
    """
    rows = rec.resource_state.filter("field = 'permits'").select("run_id", "resource", "ts", "id", "value", (~F.coalesce(F.col("op").isin("add", "sub"), F.lit(False))).alias("sets"), F.col("op").alias("_op"))
    rows = rows.withColumn("_move", F.when(F.col("_op") == "add", F.col("value")).when(F.col("_op") == "sub", -F.col("value")).otherwise(F.lit(0).cast("bigint"))).drop("_op")
    keys, place = ["run_id", "resource"], ["ts", "id"]
    total = rec.total("resource_state")
    cuts = shard_cuts(rows, keys, place, total)
    w = Window.partitionBy(*keys, "_shard").orderBy(*place)
    summed = carry(rows, cuts, keys, place, F.sum("_move"), F.sum("_sum"))
    summed = summed.withColumn("_moved", F.coalesce("_carry", F.lit(0)) + F.sum("_move").over(w)).drop("_carry", "_shard", "_hot")
    off = F.when(F.col("sets"), F.col("value") - F.col("_moved"))
    based = carry(summed, cuts, keys, place, F.max(F.when(F.col("sets"), F.struct(*place, off.alias("off")))), F.max("_sum"))
    base = F.coalesce(F.last(off, ignorenulls=True).over(w), F.col("_carry.off"), F.lit(0))
    return based.select("run_id", "resource", "ts", "id", (F.col("_moved") + base).alias("permits"), "sets")


def channel_depths(rec: Recording) -> DataFrame:
    """(run_id, resource, capacity, max_depth): the fullest each resource ever was, over all time; only where an override tells its capacity."""
    per = running_permits(rec).groupBy("run_id", "resource").agg(F.min(F.when(F.col("sets"), F.struct("ts", "id", F.col("permits").alias("v")))).alias("_first"), F.min("permits").alias("_least"))
    return per.filter("_first is not null").select("run_id", "resource", F.col("_first.v").alias("capacity"), (F.col("_first.v") - F.col("_least")).alias("max_depth"))


def park_episodes(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, id, task, resource, op_name, ts, end_ts, dur) of every park up to the run's ``at`` in ``until``.

    It ends with the task's first poll start strictly after it, else with the task, else at ``at``;
    its length is clipped there, and never negative.
    """
    # one row per run
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    parks = rec.parks.select("run_id", "task", "ts", "id", "resource", "op_name", F.lit(None).cast("bigint").alias("opens"))
    none = F.lit(None).cast("bigint")
    starts = rec.polls.select("run_id", "task", F.col("start_ts").alias("ts"), none.alias("id"), none.alias("resource"), F.lit(None).cast("string").alias("op_name"), F.col("start_ts").alias("opens"))
    both = parks.unionByName(starts)
    keys = ["run_id", "task"]
    cuts = shard_cuts(both, keys, ["ts"], rec.total("parks") + rec.total("polls"))
    # rows of one instant stay in one shard, so later shards are strictly later
    sharded = carry(both, cuts, keys, ["ts"], F.min("opens"), F.min("_sum"), after=True)
    # from the end backwards: a frame that only grows is folded once, one that shrinks anew for each row
    w = Window.partitionBy(*keys, "_shard").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, -1)
    nexts = sharded.withColumn("_next", F.coalesce(F.min("opens").over(w), F.col("_carry"))).filter("id is not null")
    nexts = nexts.join(F.broadcast(until), "run_id").filter("ts <= at")
    ends = rec.tasks.filter("end_ts is not null").select("run_id", F.col("id").alias("task"), F.col("end_ts").alias("_task_end"))
    full = nexts.join(ends, keys, "left").withColumn("end_ts", F.coalesce("_next", "_task_end", "at"))
    return full.select("run_id", "id", "task", "resource", "op_name", "ts", "end_ts", F.greatest(F.lit(0), F.least("end_ts", "at") - F.col("ts")).alias("dur"))


def without_timers(df: DataFrame, rec: Recording, scratch: Scratch | None = None) -> DataFrame:
    """Rows whose ``resource`` is no timer; unknown resources are none. With ``scratch``, the timers are written there once."""
    timers = rec.resources.filter(is_timer(F.col("concrete_type"))).select("run_id", F.col("id").alias("resource"))
    timers = timers if scratch is None else scratch.keep(timers)
    return df.join(timers, ["run_id", "resource"], "left_anti")


def hold_intervals(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, resource, task, id, start_ts, end_ts): from each acquisition to the next one or to the unlocking.

    A hold still open then is clipped at ``at``, the drop of the resource or the end of the holder;
    the end is never before the start. ``id`` is the acquisition's place in the log.
    """
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    rows = rec.resource_state.filter(f"field = '{HOLDER_FIELD}' or (field = 'locked' and value = 0)").join(F.broadcast(until), "run_id").filter("ts <= at")
    rows = rows.select("run_id", "resource", "ts", "id", "at", F.when(F.col("field") == HOLDER_FIELD, F.col("value")).alias("task"))
    keys, place = ["run_id", "resource"], ["ts", "id"]
    cuts = shard_cuts(rows, keys, place, rec.total("resource_state"))
    sharded = carry(rows, cuts, keys, place, F.min("ts"), F.last("_sum"), after=True)
    w = Window.partitionBy(*keys, "_shard").orderBy(*place)
    holds = sharded.withColumn("_closed", F.coalesce(F.lead("ts").over(w), F.col("_carry"))).filter("task is not null")
    holds = holds.join(rec.resources.select("run_id", F.col("id").alias("resource"), "drop_ts"), keys, "left")
    holds = holds.join(rec.tasks.select("run_id", F.col("id").alias("task"), F.col("end_ts").alias("_done")), ["run_id", "task"], "left")
    end = F.greatest("ts", F.coalesce("_closed", F.least("at", "drop_ts", "_done")))
    return holds.select("run_id", "resource", "task", "id", F.col("ts").alias("start_ts"), end.alias("end_ts"))


def latest_parks(rec: Recording, pairs: DataFrame) -> DataFrame:
    """(run_id, at, task, resource, since, op): of a (task, resource) of ``pairs`` the park that tells since when, by ``at``.

    One whose op is not ``poll`` outranks later ones; without any, ``at`` and ``poll``.
    """
    parks = rec.parks.join(pairs.select(*AT, "task", "resource"), ["run_id", "task", "resource"]).filter("ts <= at")
    rank = F.struct(F.coalesce(F.col("op_name") != "poll", F.lit(False)).alias("named"), "ts", "id", "op_name")
    best = parks.groupBy(*AT, "task", "resource").agg(F.max(rank).alias("_p"))
    full = pairs.join(best, [*AT, "task", "resource"], "left")
    return full.select(*pairs.columns, F.coalesce("_p.ts", "at").alias("since"), F.coalesce("_p.op_name", F.when(F.col("_p").isNull(), "poll")).alias("op"))
