"""Golden recordings, all folded at once as runs of one log."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.plans import blocked, diff, folds, hunt, latency, lint, predict, stats, tree
from causeway.recording import Recording, from_log
from causeway.schema import EVENTS
from causeway.scratch import Scratch


def S(ts, i, name=None, parent=None, kind="task"):
    return {"ts": ts, "ev": "task_spawn", "id": i, "name": name, "parent": parent, "kind": kind, "loc_file": "src/main.rs", "loc_line": 1}


def R(ts, i, kind="Mutex", line=None):
    return {"ts": ts, "ev": "resource_new", "id": i, "concrete_type": kind, "loc_file": "src/main.rs" if line else None, "loc_line": line, "is_internal": False}


def A(ts, r, t):
    return {"ts": ts, "ev": "resource_state", "resource": r, "field": "acquired_by", "value": t, "op": "override"}


def U(ts, r, value=0):
    return {"ts": ts, "ev": "resource_state", "resource": r, "field": "locked", "value": value, "op": "override"}


def P(ts, r, value, op="override"):
    return {"ts": ts, "ev": "resource_state", "resource": r, "field": "permits", "value": value, "op": op}


def B(ts, t):
    return {"ts": ts, "ev": "poll_start", "task": t}


def Z(ts, t):
    return {"ts": ts, "ev": "poll_end", "task": t}


def K(ts, t, r, op="poll_acquire"):
    return {"ts": ts, "ev": "park", "task": t, "resource": r, "op_name": op}


def W(ts, t):
    return {"ts": ts, "ev": "wake", "woken": t}


def E(ts, t):
    return {"ts": ts, "ev": "task_end", "id": t}


def D(ts, r):
    return {"ts": ts, "ev": "resource_drop", "id": r}


def poll(t, a, b, *inside):
    return [B(a, t), *inside, Z(b, t)]


DL = [
    R(1, 100, line=10), R(2, 200, line=20), S(3, 1, "t1"), S(4, 2, "t2"), *poll(1, 5, 7, A(6, 100, 1)), *poll(2, 8, 10, A(9, 200, 2)),
    *poll(1, 11, 13, K(12, 1, 200)), *poll(2, 14, 16, K(15, 2, 100)),
]


def order(t, at, first, second):
    """A task takes two locks and lets them go."""
    return [*poll(t, at, at + 1, A(at, first, t)), *poll(t, at + 2, at + 3, A(at + 2, second, t)), *poll(t, at + 4, at + 6, U(at + 4, second), U(at + 5, first))]


def gated(t, at, first, second):
    return [A(at, 9, t), *order(t, at + 10, first, second), U(at + 20, 9)]


LOCKS = [R(1, 100, line=1), R(1, 200, line=2), R(1, 300, line=3), R(1, 9, line=9), S(1, 1, "t1"), S(1, 2, "t2"), S(1, 3, "t3")]
RUNS = {
    "dl": DL,
    "idle": [S(1, 1, "solo"), *poll(1, 2, 3)],
    "root": [S(1, 1, "waiter"), R(2, 500, "Semaphore", 30), *poll(1, 3, 5, K(4, 1, 500))],
    "rel": [R(1, 100), S(2, 1), B(3, 1), A(4, 100, 1), U(5, 100, 1), U(6, 100), Z(7, 1)],
    "chan": [S(1, 1, "t1"), R(2, 300, "Semaphore"), P(3, 300, 2), P(4, 300, 1, "sub"), P(5, 300, 1, "sub"), *poll(1, 6, 16)],
    "lpoll": [S(1, 1, "cruncher"), *poll(1, 10, 110), *poll(1, 120, 125)],
    "blk": [S(1, 1, "b", kind="blocking"), *poll(1, 10, 10000)],
    "open": [S(1, 1), B(5, 1), S(1000, 2, "marker")],
    "lpark": [R(1, 7, "Mutex"), R(1, 8, "Sleep"), S(1, 1, "a"), S(1, 2, "b"), S(1000, 3, "end"), *poll(1, 9, 11, K(10, 1, 7)), *poll(2, 9, 11, K(10, 2, 8))],
    "cpu": [S(0, 1), *poll(1, 10, 110), E(110, 1)],
    "hold": [R(0, 7), S(0, 1, "waiter"), S(0, 2, "holder"), B(10, 2), A(11, 7, 2), *poll(1, 30, 50, K(40, 1, 7)), Z(910, 2), U(920, 7), W(920, 1), *poll(1, 940, 950), E(950, 1)],
    "timer": [R(0, 7, "Sleep"), S(0, 1, "sleeper"), *poll(1, 0, 30, K(20, 1, 7)), W(1030, 1), *poll(1, 1040, 1050), E(1050, 1)],
    "nowake": [R(0, 7), S(0, 1), *poll(1, 10, 30, K(20, 1, 7)), *poll(1, 530, 540), E(540, 1)],
    "clip": [R(0, 7), S(0, 1), *poll(1, 0, 30, K(20, 1, 7)), W(2030, 99)],
    "abba": [*LOCKS, *order(1, 10, 100, 200), *order(2, 50, 200, 100)],
    "gate": [*LOCKS, *gated(1, 10, 100, 200), *gated(2, 50, 200, 100)],
    "solo": [*LOCKS, *order(1, 10, 100, 200), *order(1, 50, 200, 100)],
    "cons": [*LOCKS, *order(1, 10, 100, 200), *order(2, 50, 100, 200)],
    "three": [*LOCKS, *order(1, 10, 100, 200), *order(2, 50, 200, 300), *order(3, 90, 300, 100)],
    "sleep": [R(1, 100), R(1, 8, "Sleep"), S(1, 1), A(5, 100, 1), *poll(1, 6, 9, K(7, 1, 8)), U(20, 100)],
    "self": [R(1, 100), S(2, 1, "me"), *poll(1, 3, 6, A(4, 100, 1), K(5, 1, 100))],
    "tail": [*DL, S(20, 3, "tail"), *poll(3, 21, 23, K(22, 3, 100))],
    "dup": [E(0, 1), S(1, 1, "first"), S(2, 1, "second"), B(3, 1), B(4, 1), Z(6, 1), Z(7, 1), B(8, 1), E(9, 1), E(10, 1)],
    "drop": [R(1, 100), S(1, 1, "t1"), S(1, 2, "t2"), A(3, 100, 1), D(5, 100), *poll(2, 6, 8, K(7, 2, 100)), S(9, 3)],
    "over": [R(1, 7, "Semaphore"), P(2, 7, 1, "add"), P(3, 7, 5), P(4, 7, 2, "sub"), P(5, 7, 9), P(6, 7, 1, "sub")],
    "long": [S(0, k, f"n{k}") for k in range(130)] + [R(0, 1000 + k) for k in range(130)] + [A(1, 1000 + k, k) for k in range(130)]
    + [e for k in range(129) for e in poll(k, 10, 12, K(11, k, 1001 + k))],
    "tree": [*DL, S(17, 3, "child-of-t1", parent=1), S(18, 4, "own", parent=4), S(19, 5, "lost", parent=77)],
    "base": [S(0, 1, "w"), S(0, 2, "gone"), R(0, 7), *poll(1, 10, 1010), *poll(2, 0, 500), *poll(1, 2000, 2010, K(2005, 1, 7)), *poll(1, 2110, 2111), E(2111, 1), E(500, 2)],
    "cur": [S(0, 999, "w"), S(0, 3, "new"), R(0, 7), *poll(999, 10, 5010), *poll(3, 0, 700), *poll(999, 6000, 6010, K(6005, 999, 7)), *poll(999, 16000, 16001), E(16001, 999), E(700, 3)],
}


@pytest.fixture(scope="module")
def world(spark):
    flat = [tuple({"run_id": run, "seq": k, **e}.get(f) for f in EVENTS.fieldNames()) for run, events in RUNS.items() for k, e in enumerate(events)]
    scratch = Scratch(spark)
    rec = from_log(spark.createDataFrame(flat, EVENTS), scratch=scratch)
    return rec, scratch.keep(folds.ends_of(rec)), scratch


def by_run(df):
    out = {run: [] for run in RUNS}
    for row in df.collect():
        out[row.run_id].append(row)
    return out


@pytest.fixture(scope="module")
def linked(world):
    rec, ends, scratch = world
    links = scratch.keep(blocked.wait_for(rec, ends))
    return links, scratch.keep(blocked.why_blocked(blocked.chains(links, scratch, 10)))


def test_ingest(world):
    rec, ends, _ = world
    assert {r.run_id: r.at for r in ends.collect()}["dl"] == 16
    tasks = by_run(rec.tasks)
    assert [(t.name, t.spawn_ts, t.end_ts) for t in tasks["dup"]] == [("first", 1, 9)]
    polls = sorted(by_run(rec.polls)["dup"], key=lambda p: p.id)
    assert [(p.start_ts, p.end_ts) for p in polls] == [(4, 6), (8, None)]


def test_status_and_holders(world):
    rec, ends, _ = world
    states = {k: {r.task: (r.state, r.resource) for r in v} for k, v in by_run(folds.world_tasks(rec, ends)).items()}
    assert states["dl"] == {1: ("parked", 200), 2: ("parked", 100)}
    assert states["idle"] == {1: ("idle", None)} and states["open"][1] == ("running", None) and states["cpu"] == {1: ("done", None)}
    held = {k: {r.resource: r.holder for r in v} for k, v in by_run(folds.world_resources(rec, ends)).items()}
    assert held["dl"] == {100: 1, 200: 2} and held["rel"] == {100: None} and held["drop"] == {100: None}
    early = ends.filter("run_id = 'dl'").withColumn("at", F.lit(10).cast("bigint"))
    assert {r.task: r.state for r in folds.world_tasks(rec, early).collect()} == {1: "idle", 2: "idle"}


def test_permits(world):
    rec, ends, _ = world
    got = {k: [(r.permits, r.capacity) for r in v] for k, v in by_run(folds.resource_permits(rec, ends).filter("permits is not null")).items()}
    assert got["chan"] == [(0, 2)] and got["over"] == [(8, 5)]
    depths = {k: [(r.capacity, r.max_depth) for r in v] for k, v in by_run(folds.channel_depths(rec)).items()}
    assert depths["chan"] == [(2, 2)] and depths["over"] == [(5, 4)]


def test_why_blocked(world, linked):
    links, why = linked
    got = by_run(why)
    dl = {r.task: r for r in got["dl"]}
    assert dl[1].outcome == "deadlock" and dl[1].chain == [1, 2] and dl[1].cycle == [1, 2]
    assert {r.task: r.wait_ns for r in by_run(links)["dl"]} == {1: 4, 2: 1}
    assert got["idle"] == [] and [(r.outcome, r.root, r.chain) for r in got["root"]] == [("resource_root", 500, [1])]
    assert [(r.outcome, r.cycle) for r in got["self"]] == [("deadlock", [1])]
    tail = {r.task: r for r in got["tail"]}
    assert tail[3].chain == [3, 1, 2] and tail[3].cycle == [1, 2]
    chain = {r.task: r for r in got["long"]}
    assert chain[0].chain == list(range(129)) and chain[0].root == 129 and chain[0].outcome == "active_holder"
    assert [(r.outcome, r.root) for r in got["drop"]] == [("resource_root", 100)]
    circles = by_run(blocked.deadlocks(why, links))
    assert [(r.members, r.cycle, r.resources) for r in circles["tail"]] == [([1, 2], [1, 2], [200, 100])]
    assert circles["long"] == [] and len(circles["self"]) == 1
    rec, ends, _ = world
    assert {r.run_id: r.task for r in blocked.pick_blocked(rec, ends, links).collect()}["dl"] == 1


def test_stats(world):
    rec, _, _ = world
    got = {r.run_id: r for r in stats.stats(rec).collect()}
    assert (got["dl"].tasks, got["dl"].resources, got["dl"].duration, got["dl"].polls, got["dl"].p50, got["dl"].max) == (2, 2, 15, 4, 2, 2)
    assert (got["chan"].polls, got["chan"].max) == (1, 10) and got["over"].polls == 0 and got["over"].p99 == 0
    assert stats.longest_parks(rec, 1).collect()[0].run_id == "cur"


def test_lint(world):
    rec, ends, scratch = world
    got = by_run(lint.lint(rec, ends, scratch, long_poll_ns=10, long_park_ns=100))
    short = lambda run: sorted((r.kind, r.task, r.n, r.magnitude) for r in got[run] if r.kind != "deadlock")
    assert [r.kind for r in got["dl"]] == ["deadlock"] and got["dl"][0].members == "1→2"
    assert short("lpoll") == [("long_poll", 1, 1, 100)] and got["blk"] == [] and got["idle"] == []
    assert short("open") == [("long_poll", 1, 1, 995)] and short("lpark") == [("long_park", 1, 1, 990)]
    assert [(r.kind, r.n, r.magnitude) for r in got["chan"]] == [("saturated_channel", 2, 2)]
    before = ends.filter("run_id = 'lpark'").withColumn("at", F.lit(8).cast("bigint"))
    assert lint.lint(rec, before, scratch, long_poll_ns=10, long_park_ns=100).count() == 0
    assert lint.exit_code(lint.lint(rec, ends.filter("run_id = 'dl'"), scratch)) == 2


def test_latency(world):
    rec, ends, _ = world
    got = {(r.run_id, r.task): r for r in latency.latency_buckets(rec, ends).collect()}
    for r in got.values():
        assert r.total_ns == r.own_ns + r.resource_ns + r.timer_ns + r.lag_ns + r.idle_ns, r
    assert (got["cpu", 1].total_ns, got["cpu", 1].own_ns, got["cpu", 1].idle_ns) == (110, 100, 10)
    hold = got["hold", 1]
    assert (hold.total_ns, hold.resource_ns, hold.lag_ns) == (950, 870, 20)
    assert (got["timer", 1].timer_ns, got["timer", 1].lag_ns, got["timer", 1].resource_ns) == (1000, 10, 0)
    assert (got["nowake", 1].resource_ns, got["nowake", 1].lag_ns) == (500, 0)
    assert (got["clip", 1].total_ns, got["clip", 1].resource_ns) == (2030, 2000)
    waits = latency.blamed_waits(rec, ends)
    assert {r.run_id: r.holder for r in waits.collect() if r.run_id in ("hold", "timer")} == {"hold": 2, "timer": None}
    act = latency.holder_activity(rec, latency.longest_waits(waits, 5), ends).collect()
    assert [(r.task, r.polling_ns, r.parked_ns) for r in act if r.run_id == "hold"] == [(1, 860, 0)]
    slow = {r.run_id: r.task for r in latency.pick_slow(rec, ends).collect()}
    assert slow["lpark"] == 1 and slow["base"] == 1


@pytest.mark.parametrize("small", [None, "small_units"])
def test_holder_activity_of_all_waits(spark, request, small):
    if small:
        request.getfixturevalue(small)
    rnd = random.Random(5)
    polls = [(k, 7, s, rnd.choice([s + 3, s + 1, s, s + 9, s - 2, None if s > 380 else s + 2])) for k, s in enumerate(rnd.sample(range(400), 80))] + [(90, 8, 5, None)]
    parks = [(k, rnd.choice([7, 7, 7, 8]), rnd.choice([1, 2, 3]), "x", rnd.randrange(400)) for k in range(120)]
    frames = {
        "tasks": spark.createDataFrame([("r", 7, 390), ("r", 8, None)], "run_id string, id bigint, end_ts bigint"),
        "polls": spark.createDataFrame([("r", *p) for p in polls], "run_id string, id bigint, task bigint, start_ts bigint, end_ts bigint"),
        "parks": spark.createDataFrame([("r", *p) for p in parks], "run_id string, id bigint, task bigint, resource bigint, op_name string, ts bigint"),
    }
    rec = Recording(spark, frames, {n: 500 for n in frames})
    until = spark.createDataFrame([("r", 400)], "run_id string, at bigint")
    # more than were taken at once before
    starts = [(t, g) for t in range(100, 200) for g in rnd.sample(range(395), 101)]
    waits = [("r", t, 1, "op", g, g, g + n + 2, n, 2, rnd.choice([7, 7, 8, 9])) for t, g in starts for n in [rnd.choice([1, 3, 20, 150, 390])]]
    names = "run_id string, task bigint, resource bigint, op string, since bigint, g0 bigint, g1 bigint, wait_ns bigint, lag_ns bigint, holder bigint"
    got = {(r.task, r.g0): (r.polling_ns, r.parked_ns, r.parked_on) for r in latency.holder_activity(rec, spark.createDataFrame(waits, names), until).collect()}
    episodes = [(r.task, r.id, r.resource, r.ts, r.ts + r.dur) for r in folds.park_episodes(rec, until).collect()]
    want = {}
    for _, task, _, _, _, g0, _, n, _, holder in waits:
        met = lambda s, e: min(e, g0 + n) - max(s, g0)  # noqa: B023, E731
        polling = [met(s, g0 + n if e is None else e) for _, t, s, e in polls if t == holder]
        parked = [(met(s, e), -s, -i, res) for t, i, res, s, e in episodes if t == holder and met(s, e) > 0]
        want[task, g0] = (sum(x for x in polling if x > 0), sum(p[0] for p in parked), max(parked)[3] if parked else None)
    assert len(waits) > 10_000 and got == want


def test_predict(world):
    rec, ends, scratch = world
    best, report = predict.predict(rec, ends, scratch)
    cycles, counts = by_run(best), {r.run_id: r for r in report.collect()}
    assert [(r.path, r.observed, len(set(r.tasks))) for r in cycles["abba"]] == [([100, 200], False, 2)]
    assert cycles["gate"] == [] and counts["gate"].guarded >= 1
    assert cycles["solo"] == [] and counts["solo"].single_task >= 1
    assert [(r.path, r.observed) for r in cycles["dl"]] == [([100, 200], True)]
    assert (counts["dl"].acquisitions, counts["dl"].locks, counts["dl"].order_edges) == (4, 2, 2)
    assert cycles["cons"] == [] and counts["cons"].guarded == counts["cons"].single_task == 0 and counts["cons"].order_edges >= 1
    assert [r.path for r in cycles["three"]] == [[100, 200, 300]] and counts["sleep"].order_edges == 0


def kept_rows(scratch):
    """Rows of each table written below ``scratch``."""
    import pyarrow.dataset as ds

    return [ds.dataset(f"{scratch.root.removeprefix('file://')}/{k + 1}", format="parquet").count_rows() for k in range(scratch.count)]


def brute_cycles(orders, most):
    """All simple cycles of up to ``most`` locks, from their least one, in the order of their paths."""
    found = []

    def walk(path):
        for b in sorted(orders.get(path[-1], ())):
            if b == path[0]:
                found.append(list(path))
            elif b > path[0] and b not in path and len(path) < most:
                walk([*path, b])

    for root in sorted(orders):
        walk([root])
    return sorted(found)


def test_cycles_of_dense_orders(spark):
    n = 60
    log = [R(1, 100 + k) for k in range(n)] + [S(1, k, f"t{k}") for k in range(n)] + [A(2, 100 + k, k) for k in range(n)]
    log += [e for k in range(n) for e in poll(k, 10, 12, *[K(11, k, 100 + j) for j in range(n) if j != k])]
    scratch = Scratch(spark)
    rec = from_log(spark.createDataFrame([tuple({"run_id": "dense", "seq": k, **e}.get(f) for f in EVENTS.fieldNames()) for k, e in enumerate(log)], EVENTS))
    cycles, _ = predict.predicted_cycles(rec, scratch.keep(folds.ends_of(rec)), scratch, max_cycles=8)
    # of 2,996,020 cycles the first 64: two locks, then over a third in between, then over a fourth
    want = sorted([[100, 101]] + [[100, 101, c] for c in range(102, 105)] + [[100, 101, c, d] for c in range(102, 105) for d in range(102, 160) if d != c])[:64]
    assert sorted(r.path for r in cycles.collect()) == want
    # no step writes the cycles down, of which the first lock has 198,535
    assert max(kept_rows(scratch)) < 20_000


def test_observed_looks_at_holders_only(spark):
    # tasks 1 and 2 are in a deadlock; in "late" they are never spawned, and 3 waits for them; in "none" nobody does
    late = [e for e in DL if e["ev"] != "task_spawn"]
    runs = {"dl": DL, "late": [*late, S(20, 3, "tail"), *poll(3, 21, 23, K(22, 3, 100))], "none": late}
    idle = [R(1, 8, "Sleep"), *[e for k in range(300) for e in (S(1, 1000 + k), *poll(1000 + k, 2, 4, K(3, 1000 + k, 8)))]]

    def observed(runs):
        rows = [{"run_id": run, "seq": k, **e} for run, log in runs.items() for k, e in enumerate(log)]
        rec, scratch = from_log(spark.createDataFrame([tuple(r.get(f) for f in EVENTS.fieldNames()) for r in rows], EVENTS)), Scratch(spark)
        cycles, _ = predict.predicted_cycles(rec, scratch.keep(folds.ends_of(rec)), scratch)
        return {r.run_id: (r.path, r.observed) for r in cycles.collect()}, scratch

    assert observed({"late": runs["late"], "none": runs["none"]})[0] == {"late": ([100, 200], True), "none": ([100, 200], False)}
    got, scratch = observed({"dl": [*idle, *DL]})
    # nothing is written of 300 tasks that hold no lock
    assert got == {"dl": ([100, 200], True)} and max(kept_rows(scratch)) < 100


def test_numbers_of_hot_tasks_and_copies(spark, request):
    rng, log = random.Random(11), [R(1, 100 + k) for k in range(4)] + [R(1, 8, "Sleep")]
    for ts in range(2, 90):
        task, lock = rng.randrange(3), 100 + rng.randrange(4)
        log.append(rng.choice([A(ts, lock, task), U(ts, lock), K(ts, task, lock), K(ts, task, lock), K(ts, task, 8)]))
    rec, scratch = from_log(spark.createDataFrame([tuple({"run_id": "r", "seq": k, **e}.get(f) for f in EVENTS.fieldNames()) for k, e in enumerate(log)], EVENTS)), Scratch(spark)
    ends = scratch.keep(folds.ends_of(rec))
    plain = [sorted(map(tuple, df.collect())) for df in predict.numbered(rec, ends, scratch)]
    request.getfixturevalue("small_ranges")
    rec.copies = {name: rec.tables[name].unionByName(rec.tables[name]) for name in ("parks", "resource_state")}
    tries, holds = predict.numbered(rec, ends, scratch)
    assert [sorted(map(tuple, df.collect())) for df in (tries, holds)] == plain and len(plain[0]) > 20
    # one row for each number and lock, none before the first hold
    assert tries.groupBy("task", "v", "resource").count().filter("count > 1").isEmpty() and min(t[2] for t in plain[0]) == 1


def test_cycles_brute(spark, small_units):
    rng, orders, scratch, cap = random.Random(3), {}, Scratch(spark), 5
    tries, holds = [], []
    for task in range(60):
        run = f"r{task % 2}"
        for _ in range(4):
            first, held = rng.randrange(50), rng.randrange(14)
            holds.append((run, task, held, first, first + rng.randrange(1, 24)))
        tries += [(run, task, rng.randrange(60), lock) for lock in rng.sample(range(14), 3)]
    for run, task, held, first, after in holds:
        for r, t, v, lock in tries:
            if (r, t) == (run, task) and first <= v < after and lock != held:
                orders.setdefault(run, {}).setdefault(held, set()).add(lock)
    tried = spark.createDataFrame(tries, "run_id string, task bigint, v bigint, resource bigint").distinct()
    kept = spark.createDataFrame(holds, "run_id string, task bigint, held bigint, first bigint, after bigint")
    got = sorted((r.run_id, r.path) for r in predict.simple_cycles(tried, kept, scratch, cap=cap).collect())
    want = {run: brute_cycles(orders[run], 4) for run in ("r0", "r1")}
    assert min(map(len, want.values())) > 2 * cap
    assert got == [(run, path) for run in ("r0", "r1") for path in want[run][:cap]]


def test_order_edges_of_crowded_bins(spark, small_units):
    rng = random.Random(5)
    tries = [("r", k % 2, v, rng.randrange(9), ((v + 10, 0, "x"))) for k in range(2) for v in range(60)]
    holds = [("r", rng.randrange(2), rng.randrange(9), a, a + rng.randrange(1, 30)) for a in range(0, 60, 3)]
    want = {}
    for r, t, v, lock, w in tries:
        for _, task, held, first, after in holds:
            if task == t and first <= v < after and held != lock:
                want.setdefault((r, held, lock), {}).setdefault(t, []).append(w[0])
    tried = spark.createDataFrame(tries, "run_id string, task bigint, v bigint, resource bigint, w struct<ts: bigint, turn: int, op: string>")
    edges = predict.order_edges(tried, spark.createDataFrame(holds, "run_id string, task bigint, held bigint, first bigint, after bigint"))
    assert sorted(tuple(r) for r in edges.collect()) == sorted((*k, len(x), min(min(ts) for ts in x.values())) for k, x in want.items())
    plan = edges._jdf.queryExecution().executedPlan().toString()
    # spread, combined by hash, and moved once only behind the join
    assert "_salt" in plan and "SortAggregate" not in plan and plan.split("Join")[0].count("Exchange") == 1


def test_witnesses_of_orders(world):
    rec, ends, scratch = world
    tries, holds = predict.numbered(rec, ends, scratch)
    every = {tuple(r) for r in predict.witnesses(tries, holds).collect()}
    orders = scratch.keep(ends.sparkSession.createDataFrame([("abba", 100, 200), ("three", 200, 300), ("three", 300, 200)], "run_id string, held bigint, resource bigint"))
    some = {tuple(r) for r in predict.witnesses(tries, holds, orders).collect()}
    assert some == {r for r in every if r[:3] in {("abba", 100, 200), ("three", 200, 300)}} and len(some) == 2


def test_select_witnesses():
    two = [[(1, {5, 9}), (2, {5})], [(2, {6, 9}), (1, {6})]]
    assert predict.select_witnesses(two, {5, 6}) == ("valid", [1, 1])
    assert predict.select_witnesses([[(1, {5, 9})], [(2, {6, 9})]], {5, 6}) == ("guarded", [])
    assert predict.select_witnesses([[(1, {5})], [(1, {6})]], {5, 6}) == ("single_task", [])
    assert predict.select_witnesses([[], [(1, {6})]], {5, 6}) == ("single_task", [])
    many = [[(k, {5, 9}) for k in range(100)], [(100 + k, {6, 9}) for k in range(100)]]
    assert predict.select_witnesses(many, {5, 6})[0] == "guarded"


def test_diff(world):
    rec, _, scratch = world
    got = {(r.severity, r.kind, r.key) for r in diff.diff(rec, scratch, "base", "cur", floor_ns=100).collect()}
    assert got == {(1, "poll_regression", "w"), (1, "wait_regression", "w"), (2, "new_group", "new"), (2, "removed_group", "gone")}
    back = {(r.severity, r.kind, r.key) for r in diff.diff(rec, scratch, "dl", "idle", floor_ns=100).collect()}
    assert back == {(2, "fixed_deadlock", "t1→t2")}
    assert diff.diff(rec, scratch, "base", "base", floor_ns=100).count() == 0


def test_hunt_and_tree(world):
    rec, _, scratch = world
    got = {r.key: r for r in hunt.hunt_cycles(rec, scratch).collect()}
    assert got["Mutex@src/main.rs:10→Mutex@src/main.rs:20"].observed_runs == "dl,tail,tree"
    assert got["Mutex@src/main.rs:10→Mutex@src/main.rs:20"].predicted_runs == "" and got["Mutex@src/main.rs:10→Mutex@src/main.rs:20"].predicted == 0
    assert any(r.predicted_runs and not r.observed_runs for r in got.values())
    rows = [r for r in tree.spawn_tree(rec, scratch).orderBy("place").collect() if r.run_id == "tree"]
    assert [(r.task, r.depth, r.label) for r in rows] == [(1, 0, "t1"), (3, 1, "child-of-t1"), (2, 0, "t2"), (4, 0, "own"), (5, 0, "lost")]
