"""Lock orders that could deadlock, though the run passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.tree_aggregate import order_within_key
from causeway.plans.blocked import chains, deadlocks, wait_for, why_blocked
from causeway.plans.folds import AT, hold_intervals, resource_holder, without_timers
from causeway.plans.lint import circles
from causeway.recording import Recording
from causeway.schema import HOLDER_FIELD, TABLES
from causeway.scratch import Scratch
from causeway.skew import carry, hot_buckets, salted_join, shard_cuts

MAX_CYCLE_LEN = 4
MAX_CYCLES = 16
MAX_COMBOS = 4096
#: Tries in one bin from which they are spread: each may meet many holds.
MEET_ROWS = 1024
TASK = ["run_id", "task"]


def attempts(rec: Recording, until: DataFrame, *, copies: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(run_id, task, resource, op, ts, ord, id): acquisitions, then contended parks, up to the run's end; timers left out of the parks.

    With ``copies``, rows delivered twice may come twice. With ``scratch``, the timers are written
    there, so that their size is known when they are joined.
    """
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    states, parks = (rec.repeated(name) if copies else rec.tables[name] for name in ("resource_state", "parks"))
    got = states.filter(f"field = '{HOLDER_FIELD}'").select("run_id", F.col("value").alias("task"), "resource", F.lit("acquire").alias("op"), "ts", F.lit(0).alias("ord"), "id")
    tried = without_timers(parks, rec, scratch).select("run_id", "task", "resource", F.col("op_name").alias("op"), "ts", F.lit(1).alias("ord"), "id")
    return got.unionByName(tried).join(F.broadcast(until), "run_id").filter("ts <= at").drop("at")


def versions(tries: DataFrame, holds: DataFrame, total: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Tries (run_id, task, v, resource, w, turn) and holds (run_id, task, held, first, after): what a task holds is numbered.

    The number rises when the task takes a lock and when it lets one go; a hold is there for the
    numbers from ``first`` up to, not with, ``after``, so a try lies within it if its number does.
    Of one instant, ends come first, then tries, then begins: holds are taken strictly before a try
    and let go strictly after it. All rows of a task are ordered once, hot tasks in shards. Tries of
    one lock at the same number are one, with the earliest of them, w (ts, turn, op), and the least
    turn; they are combined where they were ordered, only those of hot tasks once more. Those before
    the task took any lock, numbered 0, are left out.
    """
    spans = holds.filter("end_ts > start_ts and task is not null")
    asked = tries.select(*TASK, F.col("ts").alias("t"), F.lit(1).alias("rank"), F.col("id").alias("no"), F.col("resource").alias("lock"), "op", "ord")
    sides = F.expr("inline(array(named_struct('t', end_ts, 'rank', 0), named_struct('t', start_ts, 'rank', 2)))")
    marks = spans.select(*TASK, F.col("id").alias("no"), F.col("resource").alias("lock"), sides)
    marks = marks.select(*TASK, "t", "rank", "no", "lock", F.lit(None).cast("string").alias("op"), F.lit(None).cast("int").alias("ord"))
    # written, as the rows are read for their hot tasks, their cuts and by themselves
    rows = scratch.keep(asked.filter("task is not null").unionByName(marks))
    place = ["t", "rank", "no", "lock"]
    cuts = shard_cuts(rows, TASK, place, total)
    steps = (F.col("rank") != 1).cast("bigint")
    rows = carry(rows, cuts, TASK, place, F.sum(steps), F.sum("_sum"))
    w = Window.partitionBy(*TASK, "_shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("v", F.coalesce("_carry", F.lit(0)) + F.sum(steps).over(w)).filter("rank <> 1 or v > 0")
    turn = F.expr("CASE WHEN rank = 1 THEN struct(ord, CASE WHEN ord = 0 THEN t ELSE no END AS a, no AS id) END")
    first = F.expr("CASE WHEN rank = 1 THEN struct(t AS ts, turn, op) END")
    rows = rows.withColumn("turn", turn).withColumn("w", first).withColumn("mark", F.expr("CASE WHEN rank <> 1 THEN no END"))
    least = [F.min("w").alias("w"), F.min("turn").alias("turn")]
    rows = scratch.keep(rows.groupBy(*TASK, "_shard", "_hot", "v", "lock", "rank", "mark").agg(*least))
    found = rows.filter("rank = 1").withColumnRenamed("lock", "resource")
    again = found.filter("_hot").groupBy(*TASK, "v", "resource").agg(*least)
    found = found.filter("not _hot").select(*again.columns).unionByName(again)
    # a lock's holds follow each other, so a hold's own two marks are told apart by its place in the log
    held = rows.filter("rank <> 1").groupBy(*TASK, F.col("lock").alias("held"), "mark").agg(F.max(F.when(F.col("rank") == 2, F.col("v"))).alias("first"), F.max(F.when(F.col("rank") == 0, F.col("v"))).alias("after"))
    return found, held.select(*TASK, "held", "first", "after")


def _meet(asked: DataFrame, held: DataFrame, salt_by: list[str] | None = None) -> DataFrame:
    """``asked`` (run_id, task, v, ...) with each ``held`` of its task at that number.

    Holds fall into bins of a width, a power of 8, not below their length: at most two bins each. A
    number looks into its bin of each width, at most 21, so candidates stay near the true pairs, and
    no task's tries meet all of its holds. With ``salt_by``, the tries of crowded bins are spread by
    these columns, and _level, _bin and _salt, by which the pairs lie, are kept.
    """
    level = "cast(floor(log2(cast(greatest(1, after - first) as double)) / 3) as int) + 1"
    sized = held.withColumn("_level", F.expr(level))
    most = sized.agg(F.max("_level")).first()[0] or 1
    bins = "explode(array_distinct(array(shiftright(first, _level * 3), shiftright(after - 1, _level * 3)))) as _bin"
    binned = sized.selectExpr(*TASK, "held", "first", "after", "_level", bins)
    sought = asked.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_bin", F.expr("shiftright(v, _level * 3)"))
    keys = [*TASK, "_level", "_bin"]
    hot = hot_buckets(sought, keys, asked.count() * most, MEET_ROWS) if salt_by else None
    met = salted_join(sought, binned, keys, hot, salt_by or [], keep_salt=True).filter("first <= v and v < after").drop("first", "after")
    return met if salt_by else met.drop("_level", "_bin", "_salt")


def numbered(rec: Recording, until: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Tries and holds of the tasks that hold anything, by the number of what the task held (see versions)."""
    total = rec.total("parks") + 3 * rec.total("resource_state")
    # copies of a try are one number's tries of one lock
    tries, holds = versions(attempts(rec, until, copies=True, scratch=scratch), hold_intervals(rec, until), total, scratch)
    return scratch.keep(tries), scratch.keep(holds)


def _of_tasks(tries: DataFrame, holds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``tries`` of the tasks with one of a few ``holds``, and these, written: where their size allows it, no try is moved to meet them."""
    holds = scratch.keep(holds)
    return tries.join(holds.select(*TASK).distinct(), TASK, "left_semi"), holds


def witnesses(tries: DataFrame, holds: DataFrame, orders: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The witnesses of lock orders: of all, or of ``orders`` (run_id, held, resource) only.

    (run_id, held, resource, task, ts, op, v, turn): per order of two locks and task the earliest try
    that shows it, with the number of what the task held then; ``turn`` is its place among the edge's
    witnesses, by first try.
    """
    order = ["run_id", "held", "resource"]
    if orders is not None:
        tries = tries.join(orders.select("run_id", "resource").distinct(), ["run_id", "resource"], "left_semi")
        holds = holds.join(orders.select("run_id", "held").distinct(), ["run_id", "held"], "left_semi")
        tries, holds = _of_tasks(tries, holds, scratch or Scratch(holds.sparkSession))
    met = _meet(tries, holds).filter("held <> resource")
    if orders is not None:
        met = met.join(orders.select(*order).distinct(), order, "left_semi")
    best = met.groupBy(*order, "task").agg(F.min(F.struct("w", "v")).alias("_w"), F.min("turn").alias("turn"))
    return best.select(*order, "task", "_w.w.ts", "_w.w.op", "_w.v", "turn")


def order_edges(tries: DataFrame, holds: DataFrame) -> DataFrame:
    """(run_id, held, resource, tasks, first_ts): the lock-order graph."""
    order = ["run_id", "held", "resource"]
    # plain numbers only, which are combined by hash; witnesses with all they tell have to be sorted
    met = _meet(tries.select(*TASK, "v", "resource", "w.ts"), holds, ["resource"]).filter("held <> resource")
    # combined where they lie, then moved once, by the order alone, for both of the next steps
    each = met.groupBy(*order, "task", "_level", "_bin", "_salt").agg(F.min("ts").alias("ts")).repartition(*order)
    each = each.groupBy(*order, "task").agg(F.min("ts").alias("ts"))
    return each.groupBy(*order).agg(F.count(F.lit(1)).alias("tasks"), F.min("ts").alias("first_ts"))


def gates(asked: DataFrame, holds: DataFrame) -> DataFrame:
    """``asked`` (run_id, task, v) with ``gate``: all the task held then."""
    return _meet(asked, holds).groupBy(*asked.columns).agg(F.array_sort(F.collect_set("held")).alias("gate"))


def _before(sought: DataFrame, tries: DataFrame, holds: DataFrame, scratch: Scratch) -> DataFrame:
    """(run_id, root, lock): the locks above a root that some task held when it tried one of the root's ``sought`` (run_id, root, lock).

    No pair of a try and a hold is made: a hold asks for the next sought try of its task only. A
    sought lock may come out, too, if it was tried while held.
    """
    keys = ["run_id", "root", "task"]
    marks = tries.join(sought.withColumnRenamed("lock", "resource"), ["run_id", "resource"]).select(*keys, "v").distinct()
    marks = scratch.keep(marks)
    asks = holds.join(marks.select(*keys).distinct(), TASK).filter("held > root").select(*keys, F.col("first").alias("v"), "after", "held")
    none = F.lit(None).cast("bigint")
    rows = scratch.keep(asks.withColumn("mark", none).unionByName(marks.select(*keys, "v", none.alias("after"), none.alias("held"), F.col("v").alias("mark"))))
    cuts = shard_cuts(rows, keys, ["v"], rows.count())
    # rows of one number stay in one shard, so later shards are strictly later
    rows = carry(rows, cuts, keys, ["v"], F.min("mark"), F.min("_sum"), after=True)
    w = Window.partitionBy(*keys, "_shard").orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, 0)
    asked = rows.withColumn("_next", F.coalesce(F.min("mark").over(w), F.col("_carry"))).filter("held is not null and _next < after")
    return asked.select("run_id", "root", F.col("held").alias("lock")).distinct()


def _first_paths(paths: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each run's ``paths``, and their place ``_no``."""
    # cut in parts before a run's paths are put in order: no part needs more than the cap
    part = paths.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(64)))
    some = part.withColumn("_no", F.row_number().over(Window.partitionBy("run_id", "_part").orderBy("path"))).filter(F.col("_no") <= most).drop("_part")
    return some.withColumn("_no", F.row_number().over(Window.partitionBy("run_id").orderBy("path"))).filter(F.col("_no") <= most)


def _rooted(roots: DataFrame, tries: DataFrame, holds: DataFrame, scratch: Scratch, max_len: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(run_id, path) of the cycles from ``roots`` (run_id, root), and (run_id, stop) where a run's search was cut short.

    Only the first ``most`` beginnings of a length are followed in a run; ``stop`` is the least one
    left out, so all cycles before it are found, and those behind it are dropped.
    """
    # back[k]: locks from which a walk of up to k + 1 orders leads to the root, over locks above it
    back = [scratch.keep(_before(roots.withColumn("lock", F.col("root")), tries, holds, scratch))]
    roots = roots.join(back[0].select("run_id", "root").distinct(), ["run_id", "root"], "left_semi")
    for _ in range(max_len - 2):
        back.append(scratch.keep(back[-1].unionByName(_before(back[-1], tries, holds, scratch)).distinct()))
    path = roots.select("run_id", "root", F.array("root").alias("path"), F.col("root").alias("at"))
    closed, stops = [], []
    for length in range(2, max_len + 1):
        ends = path.select("run_id", F.col("at").alias("held")).distinct()
        out = _meet(*_of_tasks(tries.select(*TASK, "v", "resource"), holds.join(ends, ["run_id", "held"], "left_semi"), scratch))
        out = out.select("run_id", F.col("held").alias("at"), F.col("resource").alias("b")).distinct()
        # a beginning goes on only if the way that is left is long enough to come back
        step = path.join(out, ["run_id", "at"]).filter("b > root and not array_contains(path, b)")
        step = step.join(back[max_len - length].withColumnRenamed("lock", "b"), ["run_id", "root", "b"], "left_semi")
        step = step.select("run_id", "root", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"))
        found = scratch.keep(_first_paths(step, most + 1))
        stops.append(found.filter(F.col("_no") > most).select("run_id", F.col("path").alias("stop")))
        path = found.filter(F.col("_no") <= most).drop("_no")
        closed.append(path.join(back[0].withColumnRenamed("lock", "at"), ["run_id", "root", "at"], "left_semi").select("run_id", "path"))
    stop = reduce(DataFrame.unionByName, stops).groupBy("run_id").agg(F.min("stop").alias("stop"))
    sure = reduce(DataFrame.unionByName, closed).join(F.broadcast(stop), "run_id", "left").filter("stop is null or path < stop")
    return scratch.keep(sure.select("run_id", "path")), stop


def simple_cycles(tries: DataFrame, holds: DataFrame, scratch: Scratch, *, max_len: int = MAX_CYCLE_LEN, cap: int = 8 * MAX_CYCLES) -> DataFrame:
    """(run_id, path): simple cycles of 2 to ``max_len`` locks, each from its least id, the first ``cap`` of a run in the order of their paths.

    Lock orders are taken from ``tries`` and ``holds`` (see numbered) where they are needed, the graph
    of all of them isn't made. Roots are taken in rising order, in batches that grow, until each run
    has its cap: later roots could add later paths only.
    """
    locks = holds.select("run_id", F.col("held").alias("resource")).distinct()
    tries = scratch.keep(tries.select(*TASK, "v", "resource").join(locks, ["run_id", "resource"], "left_semi"))
    named = scratch.keep(tries.select("run_id", "resource").distinct().withColumn("lock", F.struct("run_id", "resource")))
    ordered = order_within_key(named, "run_id", ["resource"], "lock", named.count())
    roots = scratch.keep(ordered.select("run_id", F.col("lock.resource").alias("root"), F.col("pos").alias("no")))
    last = roots.agg(F.max("no")).first()[0] or 0
    parts = [roots.select("run_id", F.array("root").alias("path")).limit(0)]
    start, size, most = 0, 1, 2 * cap
    while start < last:
        full = reduce(DataFrame.unionByName, parts).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        left = roots.filter(F.col("no") > start).join(full.filter(F.col("n") >= cap), "run_id", "left_anti")
        batch = scratch.keep(left.filter(F.col("no") <= start + size).select("run_id", "root"))
        if batch.isEmpty():
            if left.isEmpty():
                break
            start, size = start + size, size * 4
            continue
        found, stop = _rooted(batch, tries, holds, scratch, max_len, most)
        now = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        held = full.unionByName(now).groupBy("run_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= cap)
        if not stop.join(held, "run_id", "left_anti").isEmpty():
            most *= 8
            continue
        parts.append(found)
        start, size = start + size, size * 4
    return _first_paths(reduce(DataFrame.unionByName, parts), cap).select("run_id", "path")


def select_witnesses(lists: list[list[tuple[int, set[int]]]], cycle: set[int], most: int = MAX_COMBOS) -> tuple[str, list[int]]:
    """One witness (task, locks held) per edge, tasks distinct and no lock outside the cycle held by all.

    Combinations are tried in the order of the lists, at most ``most`` of them. (outcome, choice):
    ``valid`` with the chosen places; ``guarded`` if all combinations share such a lock;
    ``single_task`` if there is no combination of distinct tasks.
    """
    chosen: list[int] = []
    tried = 0
    place = 0
    while True:
        edge = len(chosen)
        if edge == len(lists):
            tried += 1
            if not set.intersection(*(lists[k][c][1] for k, c in enumerate(chosen))) - cycle:
                return "valid", chosen
        elif tried < most:
            used = {lists[k][c][0] for k, c in enumerate(chosen)}
            nxt = next((k for k in range(place, len(lists[edge])) if lists[edge][k][0] not in used), None)
            if nxt is not None:
                chosen.append(nxt)
                place = 0
                continue
        if not chosen or tried >= most:
            return ("guarded" if tried else "single_task"), []
        place = chosen.pop() + 1


def _deadlocked(rec: Recording, until: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(run_id, locks): the locks, in order, of deadlocks at the run's end over locks of ``paths`` (run_id, path) only.

    Tasks in such a deadlock hold one of these locks then, so others' polls and parks aren't looked
    at, but for a deadlock that none of these tasks shows, as they weren't spawned: all are then.
    """
    locks = scratch.keep(paths.select("run_id", F.explode("path").alias("resource")).distinct())

    def some(name: str, key: str, of: DataFrame) -> DataFrame:
        return scratch.keep(rec.tables[name].join(of.toDF("run_id", key), ["run_id", key], "left_semi").select(*TABLES[name].fieldNames()))

    tables = {"resource_state": some("resource_state", "resource", locks), "resources": some("resources", "id", locks)}
    held = resource_holder(Recording(rec.spark, {**rec.tables, **tables}, rec.totals), until)
    tasks = scratch.keep(held.select("run_id", F.col("holder").alias("task")).distinct())
    tables |= {"tasks": some("tasks", "id", tasks), "polls": some("polls", "task", tasks), "parks": some("parks", "task", tasks)}
    part = Recording(rec.spark, {**rec.tables, **tables}, rec.totals)
    links = scratch.keep(wait_for(part, until))
    waits = scratch.keep(why_blocked(chains(links, scratch, rec.total("tasks"))).filter("outcome = 'deadlock'"))
    found = scratch.keep(deadlocks(waits, links))
    unseen = waits.select(*AT, F.array_sort("cycle").alias("members")).join(found, [*AT, "members"], "left_anti")
    if not unseen.isEmpty():
        found = circles(rec, until, scratch)
    return found.select("run_id", F.array_sort(F.array_distinct("resources")).alias("locks")).distinct()


def predicted_cycles(rec: Recording, until: DataFrame, scratch: Scratch, *, max_len: int = MAX_CYCLE_LEN, max_cycles: int = MAX_CYCLES) -> tuple[DataFrame, DataFrame]:
    """The cycles, with their outcome, and the lock-order edges.

    (run_id, path, outcome, observed, tasks, times): outcome as select_witnesses tells; ``observed``
    if the same locks are in a deadlock at the run's end; the witnesses' tasks and times for valid ones.
    """
    import pandas as pd

    tries, holds = numbered(rec, until, scratch)
    edges = order_edges(tries, holds)
    raw = scratch.keep(simple_cycles(tries, holds, scratch, max_len=max(2, max_len), cap=max(64, 8 * max_cycles)))
    hops = raw.select("run_id", "path", F.posexplode("path").alias("edge", "held"))
    hops = hops.withColumn("resource", F.element_at("path", F.pmod(F.col("edge") + 1, F.size("path")) + 1))
    # no combination within MAX_COMBOS reaches further down a list
    turn = F.row_number().over(Window.partitionBy("run_id", "held", "resource").orderBy("turn"))
    listed = witnesses(tries, holds, scratch.keep(hops.select("run_id", "held", "resource").distinct()), scratch).withColumn("_no", turn).filter(F.col("_no") <= MAX_COMBOS + max_len)
    listed = scratch.keep(listed)
    listed = listed.join(gates(listed.select(*TASK, "v").distinct(), holds), [*TASK, "v"])
    joined = hops.join(listed, ["run_id", "held", "resource"], "left").select("run_id", F.array_join("path", "→").alias("key"), "edge", "task", "ts", "gate", F.col("_no").alias("no"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["edge", "no"])
        cycle = set(map(int, rows["key"].iloc[0].split("→")))
        lists = [[(int(t), set(map(int, g))) for t, g in zip(e["task"], e["gate"]) if not pd.isna(t)] for _, e in rows.groupby("edge")]
        outcome, picks = select_witnesses(lists, cycle)
        at = [e.iloc[p] for p, (_, e) in zip(picks, rows.groupby("edge"))]
        tasks, times = [int(r["task"]) for r in at], [int(r["ts"]) for r in at]
        return pd.DataFrame({"run_id": [rows["run_id"].iloc[0]], "key": [rows["key"].iloc[0]], "outcome": [outcome], "tasks": [tasks], "times": [times]})

    chosen = joined.groupBy("run_id", "key").applyInPandas(choose, "run_id string, key string, outcome string, tasks array<bigint>, times array<bigint>")
    seen = _deadlocked(rec, until, raw, scratch).withColumn("observed", F.lit(True))
    full = chosen.withColumn("path", F.split("key", "→").cast("array<bigint>")).withColumn("locks", F.array_sort("path")).join(seen, ["run_id", "locks"], "left")
    cycles = full.select("run_id", "path", "outcome", F.coalesce("observed", F.lit(False)).alias("observed"), "tasks", "times")
    return cycles, edges


def predict(rec: Recording, until: DataFrame, scratch: Scratch, *, max_len: int = MAX_CYCLE_LEN, max_cycles: int = MAX_CYCLES) -> tuple[DataFrame, DataFrame]:
    """The report's cycles, best first, at most ``max_cycles`` a run, and its counts per run."""
    cycles, edges = predicted_cycles(rec, until, scratch, max_len=max_len, max_cycles=max_cycles)
    cycles = scratch.keep(cycles)
    order = Window.partitionBy("run_id").orderBy(F.desc("observed"), F.size("path"), F.array_min("times"), "path")
    # at most max(64, 8 * max_cycles) cycles a run
    best = cycles.filter("outcome = 'valid'").withColumn("no", F.row_number().over(order)).filter(F.col("no") <= max_cycles)
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    held = hold_intervals(rec, until).select("run_id", "resource").distinct()
    parts = [
        count(attempts(rec, until), "acquisitions"),
        count(held, "locks"),
        count(edges, "order_edges"),
        count(cycles.filter("outcome = 'guarded'"), "guarded"),
        count(cycles.filter("outcome = 'single_task'"), "single_task"),
        count(best, "cycles"),
    ]
    report = until.select("run_id").distinct()
    for part in parts:
        report = report.join(part, "run_id", "left")
    return best, report.na.fill(0)


def exit_code(best: DataFrame) -> int:
    """2 with an observed deadlock, 1 with a latent one, else 0."""
    seen = best.agg(F.max(F.col("observed").cast("int"))).first()[0]
    return 0 if seen is None else 1 + seen
