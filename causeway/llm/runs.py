"""Runs of like consecutive events, found by pointer doubling (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from causeway.scratch import Scratch
from causeway.skew import UNIT_FLOOR, carry, shard_cuts

#: Doubling 62 times would pass any run of fewer than 2**62 events.
MAX_ROUNDS = 62


def collapse_runs(
    rows: DataFrame, scratch: Scratch, total: int, *, entity: str, row_id: str, ts: str, alike: list[Column], floor: int = UNIT_FLOOR
) -> DataFrame:
    """(entity, first_id, last_id, n, duration): each longest run of two or more like neighbours.

    An entity's events are ordered by ``ts``, then ``row_id``; neighbours are alike if every
    expression of ``alike`` is equal and none is null. Each event finds its predecessor, for hot
    entities within ordered shards, whose first events get the last one of the shard before. A
    like event then points to its predecessor; in each round pointers are replaced by their
    targets' pointers, until all reach a run's start: as many self-joins as the logarithm of the
    longest run. Only events in runs are joined, and an event points to one; finished ones are left
    alone. A run's events are then counted, combined before the shuffle, so a run that holds a third
    of all rows is no hot key.

    Copies of an event (equal in all columns used) count once. Rows with a null entity, id or ts
    are left out. Events that aren't like a neighbour aren't in the result; their n would be 1. An
    empty table gives no rows.
    """
    names = [f"_a{k}" for k in range(len(alike))]
    source = rows.select(F.col(entity).alias("entity"), F.col(ts).alias("_ts"), F.col(row_id).alias("_id"), *[a.alias(n) for a, n in zip(alike, names)])
    source = source.dropna(subset=["entity", "_ts", "_id"])
    place = ["_ts", "_id"]
    cuts = shard_cuts(source, "entity", place, total, floor)
    this = F.struct("_ts", "_id", *names)
    seen = carry(source, cuts, "entity", place, F.max(this), F.last("_sum"))
    w = Window.partitionBy("entity", "_shard").orderBy("_ts", "_id", *names)
    # copies are neighbours, and in the same shard, so they need no shuffle of their own
    once = seen.withColumn("_same", F.lag(this).over(w).eqNullSafe(this)).filter("not _same")
    seen = once.withColumn("_before", F.coalesce(F.lag(this).over(w), F.col("_carry")))
    like = F.col("_before").isNotNull()
    for n in names:
        like &= F.coalesce(F.col(n) == F.col(f"_before.{n}"), F.lit(False))
    seen = seen.withColumn("_like", like)
    # done: the pointer is at a run's start; of a shard's first event, that shows in the first round
    starts = F.coalesce(~F.lag("_like").over(w), F.lit(False))
    seen = seen.withColumn("done", starts).filter("_like").select("entity", F.col("_id").alias("id"), F.col("_before._id").alias("ptr"), "_ts", F.col("_before._ts").alias("_from"), "done")

    def count(df: DataFrame) -> tuple[DataFrame, int]:
        observed = Observation()
        return scratch.keep(df.observe(observed, F.expr("count_if(not done) AS open"))), observed.get["open"]

    links, left = count(seen)
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        target = links.select("entity", F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"))
        moved = links.filter("not done").join(target, ["entity", "ptr"], "left")
        moved = moved.selectExpr("entity", "id", "coalesce(_ptr, ptr) AS ptr", "_ts", "_from", "coalesce(_done, true) AS done")
        before = links
        links, left = count(links.filter("done").unionByName(moved))
        scratch.drop(before)
    last = F.max(F.struct("_ts", "id"))
    runs = links.groupBy("entity", F.col("ptr").alias("first_id")).agg(last.alias("_last"), F.count(F.lit(1)).alias("_n"), F.min("_from").alias("_from"))
    return runs.select("entity", "first_id", F.col("_last.id").alias("last_id"), (F.col("_n") + 1).alias("n"), (F.col("_last._ts") - F.col("_from")).alias("duration"))
