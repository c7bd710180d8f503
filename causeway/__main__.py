"""python -m causeway COMMAND LOG...: reports on event logs as JSON lines; the exit code tells the worst finding.

Commands: why-blocked, why-slow, stats, lint, predict, tree, world (one or more logs, each a run),
diff BASE CURRENT.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans import blocked, diff, folds, latency, lint, predict, stats, tree
from causeway.recording import Recording, from_log
from causeway.scratch import Scratch
from causeway.sources.log_source import register


def load(spark: SparkSession, paths: list[str], mode: str, scratch: Scratch) -> Recording:
    register(spark)
    log = None
    for path in paths:
        part = spark.read.format("eventlog").option("mode", mode).load(path)
        log = part if log is None else log.unionByName(part)
    return from_log(log, scratch=scratch)


def resolve_task(rec: Recording, name: str) -> DataFrame:
    """(run_id, task): the task of that id, if there is one, else the first spawned of that name; an error if no run has any."""
    number = int(name) if name.lstrip("-").isdigit() else None
    hit = rec.tasks.filter((F.col("id") == number) | (F.col("name") == name) if number is not None else F.col("name") == name)
    if hit.isEmpty():
        raise ValueError(f"no task of id or name {name}")
    rank = F.struct((F.col("id") != number) if number is not None else F.lit(False), "spawn_ts", "id")
    return hit.groupBy("run_id").agg(F.min_by("id", rank).alias("task"))


def report(args: argparse.Namespace, rec: Recording, scratch: Scratch) -> tuple[list[DataFrame], int]:
    ends = scratch.keep(folds.ends_of(rec))
    at = ends.select("run_id", F.lit(args.at).cast("bigint").alias("at")) if args.at is not None else ends
    if args.command == "stats":
        return [stats.stats(rec), stats.longest_parks(rec, args.top), stats.full_channels(rec).orderBy(F.desc("max_depth"), "new_ts", "resource")], 0
    if args.command == "lint":
        found = scratch.keep(lint.lint(rec, at, scratch, long_poll_ns=int(args.long_poll_ms * 1e6), long_park_ns=int(args.long_park_ms * 1e6)))
        return [found.orderBy("run_id", "severity", F.desc("magnitude"))], lint.exit_code(found)
    if args.command == "predict":
        best, counts = predict.predict(rec, at, scratch, max_len=args.max_cycle_len, max_cycles=args.max_cycles)
        best = scratch.keep(best)
        return [counts, best.orderBy("run_id", "no")], predict.exit_code(best)
    if args.command == "diff":
        base, cur = (os.path.basename(p) for p in args.logs)
        found = scratch.keep(diff.diff(rec, scratch, base, cur, ratio=args.ratio, floor_ns=int(args.floor_ms * 1e6)))
        worst = found.agg(F.min("severity")).first()[0]
        return [found.orderBy("severity", "kind", "key")], {lint.ERROR: 2, lint.WARNING: 1}.get(worst, 0)
    if args.command == "tree":
        return [tree.spawn_tree(rec, scratch).orderBy("run_id", F.asc_nulls_last("place"))], 0
    if args.command == "world":
        return [folds.world_tasks(rec, at), folds.world_resources(rec, at)], 0
    if args.command == "why-slow":
        chosen = resolve_task(rec, args.task) if args.task else latency.pick_slow(rec, at)
        waits = scratch.keep(latency.longest_waits(latency.blamed_waits(rec, at).join(chosen, ["run_id", "task"]), args.top))
        return [latency.latency_buckets(rec, at).join(chosen, ["run_id", "task"]), waits.orderBy("run_id", F.desc("wait_ns")), latency.holder_activity(rec, waits, at)], 0
    links = scratch.keep(blocked.wait_for(rec, at))
    chosen = resolve_task(rec, args.task) if args.task else blocked.pick_blocked(rec, at, links)
    why = blocked.why_blocked(blocked.chains(links, scratch, rec.total("tasks")))
    full = scratch.keep(chosen.select("run_id", "task").join(why, ["run_id", "task"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_blocked"))))
    return [full], 2 if not full.filter("outcome = 'deadlock'").isEmpty() else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causeway", description=__doc__)
    parser.add_argument("command", choices=["why-blocked", "why-slow", "stats", "lint", "predict", "diff", "tree", "world"])
    parser.add_argument("logs", nargs="+")
    parser.add_argument("--task")
    parser.add_argument("--at", type=int)
    parser.add_argument("--top", type=int, default=5)
    parser.add_argument("--mode", default="FAILFAST")
    parser.add_argument("--long-poll-ms", type=float, default=1)
    parser.add_argument("--long-park-ms", type=float, default=1000)
    parser.add_argument("--max-cycle-len", type=int, default=predict.MAX_CYCLE_LEN)
    parser.add_argument("--max-cycles", type=int, default=predict.MAX_CYCLES)
    parser.add_argument("--ratio", type=float, default=diff.RATIO)
    parser.add_argument("--floor-ms", type=float, default=diff.FLOOR_NS / 1e6)
    args = parser.parse_args(argv)
    if args.command == "diff" and len(args.logs) != 2:
        parser.error("diff takes two logs")
    spark = SparkSession.builder.appName("causeway").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    scratch = Scratch(spark)
    try:
        frames, code = report(args, load(spark, args.logs, args.mode, scratch), scratch)
        for df in frames:
            for row in df.select(F.to_json(F.struct("*"))).toLocalIterator():
                print(row[0])
    except Exception as e:  # noqa: BLE001
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return code


if __name__ == "__main__":
    sys.exit(main())
