"""Where the lifetime of every task went: own polls, resources, timers, scheduler lag, idle time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.labels import is_timer
from causeway.plans.folds import park_episodes
from causeway.recording import Recording
from causeway.schema import HOLDER_FIELD
from causeway.scratch import Scratch
from causeway.skew import carry, shard_cuts

TASK = ["run_id", "task"]
#: Order of rows of one instant: a wake, a poll's start, the end of the task's window, a park.
WAKE, POLL, CLOSE, PARK = range(4)


def windows(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, at, task, w0, w1): each known task from its spawn to its end, both at most ``at``."""
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    tasks = rec.tasks.select("run_id", F.col("id").alias("task"), "spawn_ts", "end_ts").join(F.broadcast(until), "run_id")
    return tasks.select("run_id", "at", "task", F.least("spawn_ts", "at").alias("w0"), F.least("end_ts", "at").alias("w1"))


def clipped_polls(rec: Recording, spans: DataFrame) -> DataFrame:
    """(run_id, task, id, s, e, w0, w1): polls that meet their task's window, clipped to it."""
    polls = rec.polls.join(spans, TASK).filter("start_ts <= w1 and (end_ts is null or end_ts >= w0)")
    s, e = F.greatest("start_ts", "w0"), F.least(F.coalesce("end_ts", "w1"), F.col("w1"))
    return polls.select(*TASK, "id", s.alias("s"), e.alias("e"), "w0", "w1").filter("e >= s")


def _gaps(rec: Recording, spans: DataFrame) -> DataFrame:
    """(run_id, task, k, w0, w1, s, e, g0, closes, park, wake) for each poll and each window's end.

    [g0, s] is the free time before it, if g0 < s; ``park`` is the best one of the poll before it,
    ``wake`` the first time the task was woken within (g0, s]. All rows of a task are ordered once;
    wakes and parks take the number of the poll they lie ahead of, so nothing is joined by range.
    """
    none = F.lit(None).cast("bigint")
    nothing = F.lit(None).cast("struct<named:boolean,ts:bigint,id:bigint,resource:bigint,op:string>")
    polls = clipped_polls(rec, spans).select(*TASK, F.col("s").alias("t"), F.lit(POLL).alias("rank"), "id", "s", "e", "w0", "w1", nothing.alias("park"))
    closes = spans.select(*TASK, F.col("w1").alias("t"), F.lit(CLOSE).alias("rank"), F.lit(0).cast("bigint").alias("id"), F.col("w1").alias("s"), none.alias("e"), "w0", "w1", nothing.alias("park"))
    wakes = rec.wakes.select("run_id", F.col("woken").alias("task"), F.col("ts").alias("t"), "id").join(spans, TASK).filter("t > w0 and t <= w1")
    wakes = wakes.select(*TASK, "t", F.lit(WAKE).alias("rank"), "id", none.alias("s"), none.alias("e"), "w0", "w1", nothing.alias("park"))
    best = F.struct(F.coalesce(F.col("op_name") != "poll", F.lit(False)).alias("named"), "ts", "id", "resource", F.col("op_name").alias("op"))
    parks = rec.parks.join(spans, TASK).filter("ts <= w1")
    parks = parks.select(*TASK, F.col("ts").alias("t"), F.lit(PARK).alias("rank"), "id", none.alias("s"), none.alias("e"), "w0", "w1", best.alias("park"))
    rows = polls.unionByName(closes).unionByName(wakes).unionByName(parks)
    place = ["t", "rank", "id"]
    cuts = shard_cuts(rows, TASK, place, sum(rec.total(t) for t in ("polls", "parks", "wakes", "tasks")))
    counts = F.col("s").isNotNull().cast("bigint")
    latest = F.struct(*place, "e")
    rows = carry(
        rows, cuts, TASK, place,
        F.struct(F.sum(counts).alias("c"), F.max("e").alias("m"), F.max(F.when(F.col("e").isNotNull(), latest)).alias("l")),
        lambda w: F.struct(F.sum("_sum.c").over(w).alias("c"), F.max("_sum.m").over(w).alias("m"), F.max("_sum.l").over(w).alias("l")),
    )
    w = Window.partitionBy(*TASK, "_shard").orderBy(*place)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    cover = F.greatest("w0", F.max("e").over(earlier), F.col("_carry.m"))
    last_end = F.coalesce(F.last("e", ignorenulls=True).over(earlier), F.col("_carry.l.e"))
    number = F.coalesce("_carry.c", F.lit(0)) + F.sum(counts).over(w)
    seen = rows.withColumn("g0", cover).withColumn("_last", last_end).withColumn("_no", number)
    own = F.col("rank").isin(POLL, CLOSE)
    seen = seen.withColumn("k", F.when(own, F.col("_no")).otherwise(F.col("_no") + 1))
    gap = seen.groupBy(*TASK, "k").agg(
        F.max(F.when(own, F.struct("w0", "w1", "s", "e", "g0", (F.col("rank") == CLOSE).alias("closes")))).alias("_own"),
        F.max(F.when((F.col("rank") == PARK) & (F.col("t") <= F.col("_last")), F.col("park"))).alias("park"),
        F.min(F.when((F.col("rank") == WAKE) & (F.col("t") > F.col("g0")), F.col("t"))).alias("wake"),
    )
    return gap.filter("_own is not null").select(*TASK, "k", "_own.*", "park", "wake")


def wait_episodes(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, task, g0, g1, resource, op, since, wait_ns, lag_ns, timer): every gap of a task's window that isn't a poll.

    Its part before the first wake is a wait for the resource of the park that ended the poll before,
    for a timer, or idle time (resource null); the rest is scheduler lag.
    """
    gaps = _gaps(rec, windows(rec, until)).filter("g0 < s")
    timers = rec.resources.filter(is_timer(F.col("concrete_type"))).select("run_id", F.col("id").alias("resource"), F.lit(True).alias("timer"))
    wait = F.coalesce(F.col("wake"), F.col("s")) - F.col("g0")
    full = gaps.select(*TASK, "g0", F.col("s").alias("g1"), "wake", F.col("park.resource").alias("resource"), F.col("park.op").alias("op"), F.col("park.ts").alias("since"), wait.alias("wait_ns"), (F.col("s") - F.col("g0") - wait).alias("lag_ns"))
    return full.join(timers, ["run_id", "resource"], "left").withColumn("timer", F.coalesce("timer", F.lit(False)))


def latency_buckets(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, task, total_ns, own_ns, polls, resource_ns, timer_ns, lag_ns, idle_ns) of every known task.

    The five parts make up the total if a task's polls don't overlap.
    """
    spans = windows(rec, until)
    gaps = _gaps(rec, spans)
    timers = rec.resources.filter(is_timer(F.col("concrete_type"))).select("run_id", F.col("id").alias("_res"), F.lit(True).alias("timer"))
    gaps = gaps.withColumn("_res", F.col("park.resource")).join(timers, ["run_id", "_res"], "left")
    free = F.col("s") > F.col("g0")
    pre = F.when(free, F.coalesce(F.col("wake"), F.col("s")) - F.col("g0")).otherwise(F.lit(0))
    post = F.when(free, F.col("s") - F.col("g0")).otherwise(F.lit(0)) - pre
    timer = F.coalesce("timer", F.lit(False))
    parked = F.col("_res").isNotNull()
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(F.lit(0)))
    return gaps.groupBy(*TASK).agg(
        F.greatest(F.lit(0), F.max(F.col("w1") - F.col("w0"))).alias("total_ns"),
        total(~F.col("closes"), F.col("e") - F.col("s")).alias("own_ns"),
        total(~F.col("closes"), F.lit(1)).alias("polls"),
        total(parked & ~timer, pre).alias("resource_ns"),
        total(parked & timer, pre).alias("timer_ns"),
        F.sum(post).alias("lag_ns"),
        total(~parked, pre).alias("idle_ns"),
    )


def holders_then(rec: Recording, probes: DataFrame) -> DataFrame:
    """``probes`` (run_id, resource, t, ...) with ``holder``: who held the resource at ``t``, as resource_holder tells."""
    none = F.lit(None).cast("bigint")
    taken = F.when(F.col("field") == HOLDER_FIELD, F.col("value"))
    states = rec.resource_state.filter(f"field = '{HOLDER_FIELD}' or (field = 'locked' and value = 0)")
    payload = F.struct(*[c for c in probes.columns if c not in ("run_id", "resource", "t")])
    asked = probes.select("run_id", "resource", "t", F.lit(1).alias("rank"), F.monotonically_increasing_id().alias("id"), none.alias("who"), payload.alias("p"))
    told = states.select("run_id", "resource", F.col("ts").alias("t"), F.lit(0).alias("rank"), "id", taken.alias("who"), F.lit(None).cast(asked.schema["p"].dataType).alias("p"))
    keys, place = ["run_id", "resource"], ["t", "rank", "id"]
    rows = told.unionByName(asked)
    cuts = shard_cuts(told, keys, place, rec.total("resource_state"))
    last = F.struct(*place, "who")
    rows = carry(rows, cuts, keys, place, F.max(F.when(F.col("rank") == 0, last)), F.max("_sum"))
    w = Window.partitionBy(*keys, "_shard").orderBy(*place)
    rows = rows.withColumn("_last", F.coalesce(F.last(F.when(F.col("rank") == 0, last), ignorenulls=True).over(w), F.col("_carry"))).filter("rank = 1")
    rows = rows.select("run_id", "resource", "t", "p.*", F.col("_last.who").alias("holder"))
    rows = rows.join(rec.resources.select("run_id", F.col("id").alias("resource"), "drop_ts"), keys, "left")
    rows = rows.join(rec.tasks.select("run_id", F.col("id").alias("holder"), F.col("end_ts").alias("_done")), ["run_id", "holder"], "left")
    free = (F.col("drop_ts") <= F.col("t")) | (F.col("_done") <= F.col("t"))
    return rows.withColumn("holder", F.when(~F.coalesce(free, F.lit(False)), F.col("holder"))).drop("drop_ts", "_done")


def blamed_waits(rec: Recording, until: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """wait_episodes on resources, with the holder at the wait's begin: another task, and none for timers.

    With ``scratch``, the episodes are written there once.
    """
    waits = wait_episodes(rec, until).filter("resource is not null").withColumn("t", F.greatest("since", "g0"))
    waits = waits if scratch is None else scratch.keep(waits)
    held = holders_then(rec, waits).drop("t")
    return held.withColumn("holder", F.when((F.col("holder") != F.col("task")) & ~F.col("timer"), F.col("holder")))


def longest_waits(waits: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` longest waits of each task, earlier ones first among equals."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("wait_ns")).alias("_neg"), "g0", *[c for c in waits.columns if c not in ("run_id", "task", "g0")])))
    # a third of all waits may be one task's: its shares are cut to n before they meet
    part = F.pmod(F.xxhash64("g0"), F.lit(64))
    some = waits.withColumn("_part", part).withColumn("_no", F.row_number().over(Window.partitionBy(*TASK, "_part").orderBy(F.desc("wait_ns"), "g0"))).filter(F.col("_no") <= n)
    packed = some.drop("_part", "_no").groupBy(*TASK).agg(F.slice(best, 1, n).alias("_w"))
    return packed.select(*TASK, F.explode("_w").alias("_x")).select(*TASK, "_x.*").drop("_neg").select(*waits.columns)


def holder_activity(rec: Recording, waits: DataFrame, until: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``waits`` (run_id, task, g0, g1, lag_ns, holder, ...) with what the holder did meanwhile: polling_ns, parked_ns, parked_on.

    For any number of waits: all polls, parks and both ends of all waits of a holder are ordered
    once, and each end takes the time polled and parked until then from running sums. ``parked_on``
    is the resource of the first park that covers most of the wait.

    Of the parks that end with the same poll's start, only the first can be it, and these lead parks
    don't overlap: a wait meets those of a range of numbers. All but the first and last lie in it
    whole, so the range is cut into blocks of 2^k neighbours, at most two a level, with known maxima.
    """
    scratch = scratch or Scratch(rec.spark)
    waits = waits.filter("holder is not null").withColumn("_to", F.col("g1") - F.col("lag_ns"))
    parks = scratch.keep(park_episodes(rec, until).filter("dur > 0 and task is not null").select(*TASK, "id", "resource", F.col("ts").alias("s"), (F.col("ts") + F.col("dur")).alias("e")))
    leads = parks.groupBy(*TASK, "e").agg(F.min(F.struct("s", "id", "resource")).alias("_f")).select(*TASK, "_f.*", "e")
    asked = waits.select("run_id", F.col("holder").alias("task"), F.struct(F.col("task").alias("waiter"), "resource", "op", "since", "g0", "g1", "wait_ns", "lag_ns", "_to").alias("wait"))
    no_wait, no_lead = F.lit(None).cast(asked.schema["wait"].dataType), F.lit(None).cast("struct<s:bigint,e:bigint,id:bigint,resource:bigint>")

    def ends(df: DataFrame, kind: str, wait=no_wait, lead=no_lead) -> DataFrame:
        """Both ends of [s, e] as rows; of one instant, ends of lead parks, then waits, then starts of lead parks."""
        rank = {"lead": (2, 0), "wait": (1, 1)}.get(kind, (0, 0))
        sides = [F.struct(t.alias("t"), F.lit(r).alias("rank"), F.lit(w).cast("bigint").alias("w")) for t, r, w in ((F.col("s"), rank[0], 1), (F.col("e"), rank[1], -1))]
        full = df.select(*TASK, F.explode(F.array(*sides)).alias("_x"), "id", F.lit(kind).alias("kind"), wait.alias("wait"), lead.alias("lead"))
        return full.select(*TASK, "_x.*", "id", "kind", "wait", "lead").filter("t is not null")

    polls = rec.polls.filter("task is not null and start_ts is not null and (end_ts is null or end_ts >= start_ts)").select(*TASK, "id", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"))
    rows = ends(polls, "poll").unionByName(ends(parks, "park")).unionByName(ends(leads, "lead", lead=F.struct("s", "e", "id", "resource")))
    rows = rows.unionByName(ends(asked.select(*TASK, F.col("wait.g0").alias("s"), F.col("wait._to").alias("e"), F.col("wait.waiter").alias("id"), "wait"), "wait", wait=F.col("wait")))
    kept = rows = scratch.keep(rows.select("*", F.monotonically_increasing_id().alias("no")))
    scratch.drop(parks)
    place = ["t", "rank", "no"]
    cuts = shard_cuts(rows, TASK, place, rows.count())
    # sums of times outgrow 64 bits before starts and ends cancel out
    wide = F.col("w").cast("decimal(20,0)") * F.col("t").cast("decimal(20,0)")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    parts = {"pn": of("poll", F.col("w")), "pt": of("poll", wide), "kn": of("park", F.col("w")), "kt": of("park", wide)}
    parts |= {"opened": F.when((F.col("kind") == "lead") & (F.col("w") > 0), F.lit(1)), "closed": F.when((F.col("kind") == "lead") & (F.col("w") < 0), F.lit(1))}
    cast = lambda name, c: c.cast("decimal(38,0)" if name in ("pt", "kt") else "bigint")
    rows = carry(
        rows, cuts, TASK, place,
        F.struct(*[cast(n, F.sum(c)).alias(n) for n, c in parts.items()]),
        lambda w: F.struct(*[cast(n, F.sum(f"_sum.{n}").over(w)).alias(n) for n in parts]),
    )
    w = Window.partitionBy(*TASK, "_shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {n: cast(n, F.coalesce(cast(n, F.sum(c).over(w)), F.lit(0)) + F.coalesce(F.col(f"_carry.{n}"), F.lit(0))) for n, c in parts.items()}
    seen = rows.select(*TASK, "t", "w", "kind", "wait", "lead", *[c.alias(n) for n, c in so_far.items()]).filter("kind = 'wait' or (kind = 'lead' and w > 0)")
    spent = lambda n: (F.col(f"{n}n").cast("decimal(20,0)") * F.col("t").cast("decimal(18,0)") - F.col(f"{n}t")).cast("bigint")
    seen = scratch.keep(seen.select(*TASK, "w", "kind", "wait", "lead", "opened", "closed", spent("p").alias("p"), spent("k").alias("k")))
    scratch.drop(kept)

    side = lambda sign, c: F.max(F.when(F.col("w") == sign, F.col(c)))
    probes = seen.filter("kind = 'wait'").groupBy(*TASK, "wait").agg(
        (side(-1, "p") - side(1, "p")).alias("polling_ns"), (side(-1, "k") - side(1, "k")).alias("parked_ns"),
        (side(1, "closed") + 1).alias("lo"), side(-1, "opened").alias("hi"),
    )
    probes = scratch.keep(probes)
    longest = probes.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    top = max(1, longest or 1).bit_length()
    numbered = seen.filter("kind = 'lead'").select(*TASK, "lead.*", (F.col("opened") - 1).alias("no"))
    best = F.struct((F.col("e") - F.col("s")).alias("len"), (-F.col("s")).alias("a"), (-F.col("id")).alias("b"), "resource", "s", "e")
    blocks = numbered.select(*TASK, best.alias("best"), "no", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    blocks = blocks.groupBy(*TASK, "level", F.expr("shiftright(no, level)").alias("block")).agg(F.max("best").alias("best"))
    # whole leads are numbers lo .. hi - 2 from 0; the first is lo - 1, the last hi - 1
    first, after = "shiftright(lo + shiftleft(1L, v) - 1, v)", "shiftright(hi - 1, v)"
    whole = f"""flatten(transform(sequence(0, {top}), v -> array(
      CASE WHEN {first} < {after} AND {first} % 2 = 1 THEN struct(v AS level, {first} AS block) END,
      CASE WHEN {first} < {after} AND {after} % 2 = 1 THEN struct(v AS level, {after} - 1 AS block) END)))"""
    outer = "array(struct(0 AS level, lo - 1 AS block), CASE WHEN hi > lo THEN struct(0 AS level, hi - 1 AS block) END)"
    sought = probes.filter("lo <= hi").select(*TASK, F.struct("wait.waiter", "wait.g0", "wait._to").alias("x"), F.explode(F.array_compact(F.expr(f"concat({outer}, {whole})"))).alias("_b"))
    met = sought.select(*TASK, "x", "_b.level", "_b.block").join(blocks, [*TASK, "level", "block"])
    met = met.withColumn("_len", F.least("best.e", "x._to") - F.greatest("best.s", "x.g0")).filter("_len > 0")
    on = met.groupBy("run_id", F.col("x.waiter").alias("waiter"), F.col("x.g0").alias("g0")).agg(F.max(F.struct("_len", "best.a", "best.b", "best.resource")).alias("_on"))
    full = probes.select("run_id", F.col("task").alias("holder"), "wait.*", "polling_ns", "parked_ns").join(on, ["run_id", "waiter", "g0"], "left")
    return full.select(
        "run_id", F.col("waiter").alias("task"), "resource", "op", "since", "g0", "g1", "wait_ns", "lag_ns", "holder",
        "polling_ns", "parked_ns", F.col("_on.resource").alias("parked_on"),
    )


def pick_slow(rec: Recording, until: DataFrame) -> DataFrame:
    """(run_id, task): the task parked longest in sum, least id among equals; in runs without parks the longest-lived one."""
    until = until.groupBy("run_id").agg(F.max("at").alias("at"))
    summed = park_episodes(rec, until).groupBy(*TASK).agg(F.sum("dur").alias("d"))
    parked = summed.groupBy("run_id").agg(F.max(F.struct("d", (-F.col("task")).alias("n"))).alias("_p"))
    alive = rec.tasks.join(F.broadcast(until), "run_id").filter("spawn_ts <= at")
    lived = alive.groupBy("run_id").agg(F.max(F.struct((F.least("end_ts", "at") - F.col("spawn_ts")).alias("d"), (-F.col("id")).alias("n"))).alias("_l"))
    full = lived.join(parked, "run_id", "full_outer")
    return full.select("run_id", F.coalesce(-F.col("_p.n"), -F.col("_l.n")).alias("task"))
