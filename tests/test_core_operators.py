"""The general operators against brute force, with nulls, ties, copies, empty tables and extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.functions.names import plain_name
from causeway.operators.features import entity_features
from causeway.operators.hierarchy import descendants, hanging, hierarchy
from causeway.operators.intervals import busy_periods, periods_and_gaps
from causeway.operators.references import broken_references, per_period
from causeway.operators.tree_aggregate import heavy_keys, order_within_key, tree_aggregate
from causeway.scratch import Scratch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_plain_name(spark):
    names = ["poll_lease_frame", "PollLeaseFrame", "poll::lease::frame", "POLL-LEASE-FRAME#2", "poll_lease_frame #36 ", "\tPoll_lease_frame", None, "", "a#b", "a#1b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(plain_name(F.col("n"))).collect()]
    assert got == ["pollleaseframe"] * 6 + [None, "", "ab", "a1b"]


TASKS = "id bigint, parent bigint, name string, n_a bigint"
PARKS = "id bigint, task bigint, op_name string, ts bigint, _type int, _entity string"
POLLS = "id bigint, task bigint, start_ts bigint, end_ts bigint, _n bigint"


def test_features(spark):
    tasks = spark.createDataFrame([(1, None, "x", 0), (1, None, "x", 0), (2, 1, None, 0), (3, None, "", 0), (None, None, None, 0)], TASKS)
    parks = spark.createDataFrame(
        [(1, 1, "a", 5, 0, ""), (1, 1, "a", 5, 0, ""), (2, 1, "A#3", 7, 0, ""), (3, 1, "zz", 9, 0, ""), (4, 2, None, None, 0, ""), (5, 99, "a", 1, 0, ""), (6, None, "a", 1, 0, ""), (None, 1, "a", 50, 0, "")], PARKS
    )
    polls = spark.createDataFrame([(1, 1, 10, 15, 0), (1, 1, 10, 15, 0), (2, 1, 20, None, 0), (3, 1, 9, 5, 0), (4, 3, 0, 0, 0)], POLLS)
    got = entity_features(tasks, parks, ["a", "b"], type_key=plain_name, spans=polls)
    assert got.columns == ["id", "n_a", "last_a", "n_b", "last_b", "n_other", "last_other", "n_spans", "span_time"]
    assert rows(got) == [(1, 2, 7, 0, None, 1, 9, 3, 5), (2, 0, None, 0, None, 1, None, 0, 0), (3, 0, None, 0, None, 0, None, 1, 0)]
    none = entity_features(tasks, parks.limit(0), ["a"], spans=polls.limit(0))
    assert rows(none) == [(k, 0, None, 0, None, 0, 0) for k in (1, 2, 3)]
    assert rows(entity_features(tasks.limit(0), parks, ["a"])) == []
    with pytest.raises(ValueError):
        entity_features(tasks, parks, [str(k) for k in range(5000)])


@pytest.mark.parametrize("small", [None, "small_units", "small_ranges"])
def test_references(spark, request, small):
    if small:
        request.getfixturevalue(small)
    parents = spark.createDataFrame([(1, 10, None, "x"), (1, 10, 50, "y"), (2, 0, None, "z"), (None, 0, 1, "")], "id bigint, since bigint, until bigint, reason string")
    facts = [(k, 1, ts) for k, ts in enumerate([9, 10, 50, 51, None, 30])] + [(10, 7, 1), (10, 7, 1), (11, None, 1), (12, 2, -5), (None, 7, 1), (13, 7, None)]
    refs = spark.createDataFrame([(*f, "q") for f in facts], "id bigint, ref bigint, ts bigint, reason string")
    got = broken_references(refs, parents, ref="ref", row_id="id", ts="ts", since="since", until="until", total=len(facts))
    want = [(0, 9, "not_yet"), (3, 51, "ended"), (10, 1, "missing"), (12, -5, "not_yet"), (13, None, "missing")]
    assert rows(got) == sorted(want, key=repr)
    assert len(rows(broken_references(refs, parents.limit(0), ref="ref", row_id="id", ts="ts", total=1))) == 9
    assert rows(broken_references(refs.limit(0), parents, ref="ref", row_id="id", ts="ts", total=0)) == []
    assert rows(per_period(got.filter("ts is not null"), 50)) == sorted([("not_yet", 0, 1), ("ended", 50, 1), ("missing", 0, 1), ("not_yet", -50, 1)], key=repr)


def test_tree_aggregate(spark):
    data = [(k, 1 if k % 3 else k % 7, k * 3 % 11) for k in range(400)] + [(5, 1, 4), (None, 1, 9), (1000, None, 2), (1001, 4, None)]
    df = spark.createDataFrame([(*d, "e") for d in data], "id bigint, key bigint, v bigint, _node string").drop("_node").withColumn("n", F.lit("extra"))
    got = tree_aggregate(df, ["key"], "id", {"n": ("count", "id"), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}, 400, chunk_rows=8, fan_in=2)
    once = {i: (k, v) for i, k, v in data if i is not None}
    keys = {k for k, _ in once.values()}
    want = []
    for key in keys:
        vs = [v for k, v in once.values() if k == key]
        known = [v for v in vs if v is not None]
        want.append((key, len(vs), sum(known), max(known), min(known)))
    assert rows(got) == sorted(want, key=repr)
    assert rows(tree_aggregate(df.limit(0), ["key"], "id", {"n": ("count", "id")}, 0)) == []
    held = heavy_keys(df, "key", "id", 0.5, 400, Scratch(spark))
    assert [r.key_value for r in held.collect()] == [1]


@pytest.mark.parametrize("small", [None, "small_units", "small_ranges"])
def test_order_within_key(spark, request, small):
    if small:
        request.getfixturevalue(small)
    rnd = random.Random(1)
    data = [(k, rnd.choice([1, 1, 1, 2, 3]), rnd.choice([None, 1, 2, 2, 2, 5, 9])) for k in range(200)] + [(500, None, 1), (None, 1, 1)]
    df = spark.createDataFrame(data + data[:20], "id bigint, key bigint, ts bigint")
    got = {(r.id, r.key): r.pos for r in order_within_key(df, "key", ["ts"], "id", len(data)).collect()}
    want = {}
    for key in (1, 2, 3):
        mine = sorted((d for d in data if d[1] == key and d[0] is not None), key=lambda d: (d[2] is not None, d[2] or 0, d[0]))
        want |= {(d[0], key): k for k, d in enumerate(mine, 1)}
    assert got == want


def test_order_of_both_tables(spark, tmp_path):
    import __spark_entry__ as entry

    polls = [(1, 7, 5, 6), (2, 7, 3, None), (2, 7, 3, None), (3, None, 1, 2)]
    parks = [(1, 7, 9, "a", 5), (2, 8, 9, "a", 4), (3, 8, None, "a", 1), (4, 8, 6, "a", 4), (4, 8, 6, "a", 4)]
    spark.createDataFrame(polls, "id bigint, task bigint, start_ts bigint, end_ts bigint").write.parquet(f"{tmp_path}/polls.parquet")
    spark.createDataFrame(parks, "id bigint, task bigint, resource bigint, op_name string, ts bigint").write.parquet(f"{tmp_path}/parks.parquet")
    got = entry.queries()["p4_order_all"](spark, str(tmp_path))
    assert got.columns == ["table_name", "key_field", "id", "key_value", "pos"]
    want = [("polls", "task", 2, 7, 1), ("polls", "task", 1, 7, 2), ("parks", "resource", 2, 9, 1), ("parks", "resource", 1, 9, 2), ("parks", "resource", 4, 6, 1)]
    assert rows(got) == sorted(want, key=repr)


def brute_tree(nodes):
    out = {}
    for v in nodes:
        path, seen, x = [], set(), v
        while x is not None and x in nodes and x not in seen:
            path.append(x)
            seen.add(x)
            x = nodes[x]
        if x is None or x not in nodes:
            out[v] = (path[-1], len(path) - 1, list(reversed(path)), "rooted")
        else:
            out[v] = (None, None, None, "on_cycle" if x == v else "below_cycle")
    return out


@pytest.mark.parametrize("small", [None, "small_units", "small_ranges"])
def test_hierarchy(spark, request, small):
    if small:
        request.getfixturevalue(small)
    rnd = random.Random(3)
    nodes = {k: (None if k < 2 else rnd.randrange(k)) for k in range(40)}
    nodes |= {k: k - 1 for k in range(101, 130)} | {100: None}  # a chain
    nodes |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 203, 210: 210, 211: 210}  # cycles
    nodes |= {300: 999, 301: 300, 302: 301, 310: 998}  # missing parents
    data = [("g", k, p, "x") for k, p in nodes.items()] + [("h", 200, 1, "x"), ("h", 1, None, "x"), ("g", 300, None, "x"), ("g", None, 5, "x")]
    df = spark.createDataFrame(data + data[:5], "grp string, id bigint, parent bigint, depth string")
    got = hierarchy(df, Scratch(spark), len(data))
    mine = {r.id: (r.root, r.depth, r.path, r.state) for r in got.collect() if r.grp == "g"}
    assert mine == brute_tree(nodes)
    assert {r.id: r.path for r in got.collect() if r.grp == "h"} == {1: [1], 200: [1, 200]}
    pairs = {(r.ancestor, r.id, r.distance) for r in descendants(got).collect() if r.grp == "g"}
    assert pairs == {(a, v, len(p) - 1 - k) for v, (_, _, p, s) in brute_tree(nodes).items() if s == "rooted" for k, a in enumerate(p[:-1])}
    assert rows(hierarchy(df.limit(0), Scratch(spark), 0)) == []


@pytest.mark.parametrize("small", [None, "small_units", "small_ranges"])
def test_hanging(spark, request, small):
    if small:
        request.getfixturevalue(small)
    rnd = random.Random(4)
    nodes = {1: 3, 2: 1, 3: 2, 4: 4, 5: 6, 6: 5}  # circles of three, one and two
    nodes |= {10: 1, 11: 10, 20: 4, 30: None, 31: 30}
    nodes |= {100: 2} | {k: k - 1 for k in range(101, 130)}  # a chain below a circle
    nodes |= {k: rnd.choice([1, 2, 3, 5, 129, *range(200, k)]) for k in range(200, 240)}
    df = spark.createDataFrame([("g", k, p) for k, p in nodes.items()] + [("h", 7, 7), ("h", 8, 7)], "grp string, id bigint, parent bigint")
    placed = hierarchy(df, Scratch(spark), len(nodes))
    state = {v: s for v, (_, _, _, s) in brute_tree(nodes).items()}
    want = {("h", 7, 8, 1)}
    for v in nodes:
        x, steps = v, 0
        while state[v] == "below_cycle" and state[x] != "on_cycle":
            x, steps = nodes[x], steps + 1
            want.add(("g", x, v, steps))
    got = [tuple(r) for r in hanging(placed).collect()]
    assert set(got) == want and len(got) == len(want)
    assert rows(descendants(placed)) == [("g", 30, 31, 1)]


def brute_periods(data):
    out = []
    for task in {d[1] for d in data}:
        spans = sorted({(s, e, i) for i, t, s, e in data if t == task and i is not None and s is not None and e is not None and e >= s and t is not None})
        cur = None
        for s, e, _ in spans:
            if cur and s <= cur[1]:
                cur[1], cur[2] = max(cur[1], e), cur[2] + 1
            else:
                if cur:
                    out.append((task, *cur))
                cur = [s, e, 1, cur[1] if cur else None]
        if cur:
            out.append((task, *cur))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [None, "small_units", "small_ranges"])
@pytest.mark.parametrize("seed", [1, 2])
def test_intervals(spark, request, small, seed):
    if small:
        request.getfixturevalue(small)
    rnd = random.Random(seed)
    data = []
    for k in range(150):
        s = rnd.randrange(300)
        data.append((k, rnd.choice([1, 1, 1, 2, 3, None]), s, rnd.choice([s, s + rnd.randrange(9), s + rnd.randrange(9), s + 40, s - 1, None])))
    data += [(900, 1, 0, 290)] if seed == 2 else []
    df = spark.createDataFrame([(*d, 1) for d in data + data[:30]], "id bigint, task bigint, start_ts bigint, end_ts bigint, n int")
    got = busy_periods(df, "task", "id", len(data))
    assert rows(got) == brute_periods([d for d in data if d[1] is not None])
    spans = periods_and_gaps(got, least_n=2, least_gap=2, most_gap=5)
    want = [(t, "period", s, e) for t, s, e, n, _ in brute_periods([d for d in data if d[1] is not None]) if n >= 2]
    want += [(t, "gap", f, s) for t, s, e, n, f in brute_periods([d for d in data if d[1] is not None]) if f is not None and 2 <= s - f <= 5]
    assert rows(spans) == sorted(want, key=repr)
    assert rows(busy_periods(df.limit(0), "task", "id", 0)) == []
