"""Summary statistics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.plans.folds import bounds, channel_depths, ends_of, park_episodes
from causeway.recording import Recording


def poll_percentiles(rec: Recording) -> DataFrame:
    """(run_id, n, p50, p90, p99, max): nearest rank, round((n - 1) * q) half up, of closed forward polls; exact.

    Equal durations are counted first, partially before the shuffle. Ranks are then found in two
    levels: the counts of wide value ranges are summed up, and only the ranges that hold a rank are
    put in order.
    """
    took = rec.polls.filter("end_ts >= start_ts").select("run_id", (F.col("end_ts") - F.col("start_ts")).alias("took"))
    counted = took.groupBy("run_id", "took").agg(F.count(F.lit(1)).alias("c"))
    # a range is one 1024th of a power of two: at most 64k ranges a run
    power = F.floor(F.log2(F.greatest("took", F.lit(1)).cast("double"))).cast("int")
    wide = F.floor(F.col("took") / F.pow(F.lit(2.0), F.greatest(F.lit(0), power - 10))).cast("bigint")
    ranged = counted.withColumn("_range", F.struct(power.alias("p"), wide.alias("w")))
    sums = ranged.groupBy("run_id", "_range").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("run_id").orderBy("_range")
    upto = sums.select("run_id", "_range", (F.sum("c").over(w) - F.col("c")).alias("_before"), F.col("c").alias("_in"), F.sum("c").over(Window.partitionBy("run_id")).alias("n"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) * q + 0.5).alias("rank")) for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))])
    hit = upto.withColumn("_r", F.explode(ranks)).filter("_r.rank >= _before and _r.rank < _before + _in")
    needed = hit.select("run_id", "_range", "_before", "n").distinct()
    inner = ranged.join(needed, ["run_id", "_range"])
    placed = inner.withColumn("_upto", F.col("_before") + F.sum("c").over(Window.partitionBy("run_id", "_range").orderBy("took")))
    placed = placed.withColumn("_r", F.explode(ranks)).filter("_r.rank >= _upto - c and _r.rank < _upto")
    return placed.groupBy("run_id", "n").agg(*[F.max(F.when(F.col("_r.name") == name, F.col("took"))).alias(name) for name in ("p50", "p90", "p99", "max")])


def full_channels(rec: Recording) -> DataFrame:
    """(run_id, resource, capacity, max_depth, new_ts) of known resources with a capacity above 1."""
    known = rec.resources.select("run_id", F.col("id").alias("resource"), "new_ts")
    return channel_depths(rec).filter("capacity > 1").join(known, ["run_id", "resource"])


def longest_parks(rec: Recording, n: int = 10) -> DataFrame:
    """The ``n`` longest park episodes of all runs, earlier ones first among equals."""
    return park_episodes(rec, ends_of(rec)).orderBy(F.desc("dur"), "ts", "id").limit(n)


def stats(rec: Recording) -> DataFrame:
    """(run_id, duration, tasks, resources, polls, p50, p90, p99, max) of each run."""
    tasks = rec.tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"))
    resources = rec.resources.groupBy("run_id").agg(F.count(F.lit(1)).alias("resources"))
    full = bounds(rec).join(tasks, "run_id", "left").join(resources, "run_id", "left").join(poll_percentiles(rec), "run_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0).cast("bigint")).alias(name)
    return full.select(
        "run_id", F.greatest(F.lit(0), F.col("max_ts") - F.col("min_ts")).alias("duration"), *[zero(c, c) for c in ("tasks", "resources")], zero("n", "polls"), *[zero(c, c) for c in ("p50", "p90", "p99", "max")]
    )
