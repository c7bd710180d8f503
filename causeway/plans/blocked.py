"""Who waits for whom: wait-for links, blocking chains and deadlock cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.folds import AT, latest_parks, resource_holder, task_status
from causeway.recording import Recording
from causeway.scratch import Scratch
from causeway.skew import hot_buckets, salted_join

#: Doublings of a chain's known length; 2**40 links are more than any recording has.
MAX_ROUNDS = 40


def wait_for(rec: Recording, instants: DataFrame) -> DataFrame:
    """(run_id, at, task, resource, op, since, wait_ns, holder, spawn_ts): one link per parked task; holder may be null."""
    parked = task_status(rec, instants).filter("state = 'parked'").select(*AT, "task", "resource", "spawn_ts", "visible")
    links = latest_parks(rec, parked)
    held = resource_holder(rec, instants)
    # one row per resource on one side, hot resources on the other
    hot = hot_buckets(links, [*AT, "resource"], rec.total("tasks"))
    links = salted_join(links, held, [*AT, "resource"], hot, ["task"], "left")
    return links.select(*AT, "task", "resource", "op", "since", F.greatest(F.lit(0), F.col("at") - F.col("since")).alias("wait_ns"), "holder", "spawn_ts", "visible")


def chains(links: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """``links`` with ``chain``: the tasks from each one along the holders, itself first.

    The chain ends with the task that holds nothing awaited or isn't parked, or, where holders run
    in a circle, with the last task not met before; ``next`` is then the holder met again, otherwise
    the holder that isn't parked, or null. Chains double with each round, so there are as many
    rounds as the logarithm of the longest chain.
    """
    links = scratch.keep(links)
    paths = links.select(*AT, "task", F.array("task").alias("chain"), F.col("holder").alias("next"), F.lit(False).alias("done"))
    for _ in range(MAX_ROUNDS):
        # rows go on while their next one is parked and new to the chain
        step = paths.select(*AT, F.col("task").alias("next"), F.col("chain").alias("_chain"), F.col("next").alias("_next"))
        open_rows = paths.filter("not done and next is not null and not array_contains(chain, next)")
        hot = hot_buckets(open_rows, [*AT, "next"], total)
        joined = salted_join(open_rows, step, [*AT, "next"], hot, ["task"], "left")
        both = F.concat("chain", "_chain")
        # cut before the first task met twice
        fresh = F.array_distinct(both)
        looped = F.size(fresh) < F.size(both)
        again = F.element_at(both, F.size(fresh) + 1)
        moved = joined.select(
            *AT,
            "task",
            F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(fresh).alias("chain"),
            F.when(F.col("_chain").isNull(), F.col("next")).when(looped, again).otherwise(F.col("_next")).alias("next"),
            F.col("_chain").isNull().alias("done"),
        )
        rest = paths.filter("done or next is null or array_contains(chain, next)").withColumn("done", F.lit(True))
        paths = scratch.keep(rest.unionByName(moved))
        if paths.filter("not done and next is not null and not array_contains(chain, next)").isEmpty():
            break
    return links.join(paths.drop("done"), [*AT, "task"])


def why_blocked(chained: DataFrame) -> DataFrame:
    """(run_id, at, task, outcome, chain, cycle, root): outcome ``deadlock`` with its cycle, ``active_holder`` (root the holder) or ``resource_root`` (root the resource) for each parked task.

    Tasks without a row are ``not_blocked``.
    """
    met = F.array_position("chain", F.col("next"))
    looped = F.col("next").isNotNull() & (met > 0)
    last = chained.select(*AT, F.col("task").alias("_end"), F.col("resource").alias("_resource"))
    ended = chained.withColumn("_end", F.element_at("chain", -1)).join(last, [*AT, "_end"], "left")
    return ended.select(
        *AT,
        "task",
        F.when(looped, "deadlock").when(F.col("next").isNotNull(), "active_holder").otherwise("resource_root").alias("outcome"),
        "chain",
        F.when(looped, F.expr("slice(chain, cast(array_position(chain, next) as int), size(chain))")).alias("cycle"),
        F.when(looped, F.lit(None).cast("bigint")).otherwise(F.coalesce("next", "_resource")).alias("root"),
    )


def deadlocks(blocked: DataFrame, links: DataFrame) -> DataFrame:
    """(run_id, at, members, cycle, resources): each set of tasks in a circle once, turned as the first visible task in spawn order meets it."""
    found = blocked.filter("outcome = 'deadlock'").join(links.filter("visible").select(*AT, "task", "spawn_ts"), [*AT, "task"])
    first = found.groupBy(*AT, F.array_sort("cycle").alias("members")).agg(F.min(F.struct("spawn_ts", "task", "chain", "cycle")).alias("_f"))
    inner = first.select(*AT, "members", F.col("_f.cycle").alias("cycle"), F.col("_f.chain").alias("chain"), F.posexplode("_f.chain").alias("_at", "task"))
    inner = inner.filter(F.array_contains("members", F.col("task"))).join(links.select(*AT, "task", "resource"), [*AT, "task"])
    return inner.groupBy(*AT, "members", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "resource"))), lambda x: x["resource"]).alias("resources"))


def pick_blocked(rec: Recording, instants: DataFrame, links: DataFrame) -> DataFrame:
    """(run_id, at, task): the first task in spawn order parked on a resource that another one holds, else the first parked, else the last spawned."""
    visible = rec.tasks.join(F.broadcast(instants), "run_id").filter("spawn_ts <= at").select(*AT, F.col("id").alias("task"), "spawn_ts")
    full = visible.join(links.select(*AT, "task", "holder", F.lit(True).alias("_parked")), [*AT, "task"], "left")
    by_other = F.col("holder").isNotNull() & (F.col("holder") != F.col("task"))
    best = full.groupBy(*AT).agg(
        F.min(F.when(by_other, F.struct("spawn_ts", "task"))).alias("_a"),
        F.min(F.when(F.col("_parked"), F.struct("spawn_ts", "task"))).alias("_b"),
        F.max(F.struct("spawn_ts", "task")).alias("_c"),
    )
    return best.select(*AT, F.coalesce("_a.task", "_b.task", "_c.task").alias("task"))


