"""Parent-child links to full hierarchies by tree contraction (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from causeway.scratch import Scratch
from causeway.skew import hot_buckets, salted_join

KEY = ["grp", "id"]
#: A contraction of 2**31 nodes takes fewer rounds than this.
MAX_ROUNDS = 400
#: What became of a node: still there, spliced out of a chain, raked as a leaf, left as a core.
STAY, SPLICE, RAKE, CORE = 0, 1, 2, 3
#: Kinds of cores: a root, a parent that names no node, a node that became its own parent.
ROOT, GHOST, CIRCLE = 0, 1, 2
#: Up to so many active nodes, BATCH rounds are written as one table; a larger set after each round.
SMALL, BATCH = 1_000_000, 4

#: An edge that hides nothing yet.
_VIA = ", CAST(array() AS array<bigint>) AS via"


def _none() -> Column:
    return F.lit(None).cast("bigint")


def _start(nodes: DataFrame, paths: bool) -> DataFrame:
    """A row per node, and per id that is only named as a parent, with its number of children and one of them.

    ``parent``, ``weight``, ``via`` and ``top`` describe the edge upwards: how many links it stands
    for, the nodes it hides, from above, and the uppermost node on it below ``parent``.
    """
    return nodes.sparkSession.sql(
        f"""
WITH own AS (SELECT grp, id, max(parent) AS parent FROM {{nodes}} WHERE grp IS NOT NULL AND id IS NOT NULL GROUP BY grp, id),
told AS (SELECT inline(array(
    named_struct('grp', grp, 'id', id, 'parent', parent, 'own', 1, 'ping', 0, 'child', CAST(NULL AS BIGINT)),
    named_struct('grp', grp, 'id', parent, 'parent', NULL, 'own', 0, 'ping', int(parent <> id), 'child', CASE WHEN parent <> id THEN id END)
  )) FROM own)
SELECT grp, id, max(parent) AS origin, max(own) AS own, max(parent) AS parent, 1L AS weight, id AS top, sum(ping) AS kids, min(child) AS kid, {STAY} AS step, 0 AS round{_VIA if paths else ""}
FROM told WHERE id IS NOT NULL GROUP BY grp, id""",
        nodes=nodes,
    )


#: What describes a node besides its edge upwards and its children.
_OWN = ["origin", "own", "step", "round"]


def _rounds(state: DataFrame, count: int, paths: bool) -> DataFrame:
    """``count`` rounds of one compression and one raking of the nodes that stay; the others pass by.

    Spliced nodes have a single child, a parent other than themselves, and a greater random rank
    than both, so no two neighbours go at once; the child takes over the edge. Then leaves go, and
    the nodes that stay are counted by their parents anew. So the parent of whatever was taken out
    is there after the round. Children are counted and edges handed on by grouped aggregates, which
    combine before the shuffle: a parent of very many children is no hot key. A round is two of them,
    without a join, so several in a row are still a plan without branches.
    """
    edge = ["parent", "weight", "top", *(["via"] if paths else [])]
    mine = [*_OWN, *edge, "kids", "kid"]
    lift = {"up": "parent", "add": "weight", "over": "top", **({"hid": "concat(via, array(id))"} if paths else {})}
    fields = lambda names, given: "named_struct('grp', grp, " + ", ".join(f"'{n}', {given.get(n, 'NULL')}" for n in names) + ")"
    kept = lambda names: ", ".join(f"max({n}) AS {n}" for n in names)
    itself = {n: n for n in ["id", *mine]}
    first, second = ["id", *mine, *lift], ["id", *mine, "ping", "child"]
    rank = lambda c: f"xxhash64(round, grp, {c})"
    stays, linked = f"step = {STAY}", "parent IS NOT NULL AND parent <> id"
    parts = []
    for k in range(count):
        parts += [
            f"m{k} AS (SELECT *, coalesce({stays} AND {linked} AND kids = 1 AND {rank('id')} > {rank('parent')} AND {rank('id')} > {rank('kid')}, false) AS goes FROM {f's{k}' if k else '{state}'})",
            f"""e{k} AS (SELECT inline(filter(array(
    {fields(first, {**itself, "step": f"CASE WHEN goes THEN {SPLICE} ELSE step END"})},
    CASE WHEN goes THEN {fields(first, {"id": "kid", **lift})} END), x -> x IS NOT NULL)) FROM m{k})""",
            f"f{k} AS (SELECT grp, id, {kept([*mine, *lift])} FROM e{k} GROUP BY grp, id)",
            f"""l{k} AS (SELECT grp, id, origin, own, coalesce(up, parent) AS parent, weight + coalesce(add, 0) AS weight, coalesce(over, top) AS top, {"CASE WHEN up IS NULL THEN via ELSE concat(hid, via) END AS via, " if paths else ""}
    kids, kid, step, round FROM f{k})""",
            f"""d{k} AS (SELECT *, CASE WHEN {stays} AND kids = 0 AND {linked} THEN {RAKE} WHEN {stays} AND kids = 0 THEN {CORE} ELSE step END AS now FROM l{k})""",
            f"""c{k} AS (SELECT inline(filter(array(
    {fields(second, {**itself, "step": "now", "ping": "0L"})},
    CASE WHEN now = {STAY} AND {linked} THEN {fields(second, {"id": "parent", "ping": "1L", "child": "id"})} END), x -> x IS NOT NULL)) FROM d{k})""",
            f"g{k} AS (SELECT grp, id, {kept(mine)}, sum(ping) AS pings, min(child) AS child FROM c{k} GROUP BY grp, id)",
            f"""s{k + 1} AS (SELECT grp, id, origin, own, {", ".join(edge)}, CASE WHEN {stays} THEN pings ELSE kids END AS kids, CASE WHEN {stays} THEN child ELSE kid END AS kid, step,
    CASE WHEN {stays} THEN round + 1 ELSE round END AS round FROM g{k})""",
        ]
    return state.sparkSession.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM s{count}", state=state)


def _contract(start: DataFrame, scratch: Scratch, total: int, paths: bool) -> tuple[list[tuple[DataFrame, int]], int]:
    """The records of all rounds, a table and its number of rounds each, and the number of circles."""
    written, state, active, rounds, circles = [], start, total, 0, 0
    while active:
        if rounds >= MAX_ROUNDS:
            raise RuntimeError("the contraction doesn't end")
        batch = 1 if active > SMALL else BATCH
        seen = Observation()
        tell = [F.expr(f"count_if(step = {STAY}) AS active"), F.expr(f"count_if(step = {CORE} AND parent IS NOT NULL) AS circles")]
        table = scratch.keep(_rounds(state, batch, paths).observe(seen, *tell))
        written.append((table, batch))
        active, circles, rounds = seen.get["active"], circles + seen.get["circles"], rounds + batch
        state = table.filter(F.col("step") == STAY)
    return written, circles


def _cores(written: list[tuple[DataFrame, int]], paths: bool) -> DataFrame:
    every = reduce(DataFrame.unionByName, [t for t, _ in written]).filter(F.col("step") == CORE)
    kind = F.when(F.col("parent").isNotNull(), CIRCLE).when(F.col("own") == 0, GHOST).otherwise(ROOT)
    return every.select(*KEY, "origin", "own", F.col("id").alias("core"), kind.alias("kind"), F.lit(0).cast("bigint").alias("weight"), _none().alias("top"), *([F.array().cast("array<bigint>").alias("via")] if paths else []), _none().alias("kid"), "step")


def _above(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    return df.select("grp", F.col("id").alias(by), *[F.col(c).alias(f"_{c}") for c in names])


def _within(taken: DataFrame, rounds: int, paths: bool) -> DataFrame:
    """The records of a batch with parents that outlast it: each step back passes two rounds, then four, ..."""
    extra = ["via"] if paths else []
    for _ in range((rounds - 1).bit_length()):
        above = _above(taken, "parent", ["parent", "weight", "top", *extra])
        # a batch of several rounds is small, and its joins need no broadcast through the driver
        found = taken.join(above.hint("merge"), ["grp", "parent"], "left")
        met = F.col("_parent").isNotNull()
        taken = found.select(
            *KEY, "origin", "own", F.coalesce("_parent", "parent").alias("parent"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"), F.coalesce("_top", "top").alias("top"),
            *([F.when(met, F.concat("_via", F.array("parent"), "via")).otherwise(F.col("via")).alias("via")] if paths else []), "kid", "step",
        )
    return taken


def _place(taken: DataFrame, placed: DataFrame, hot, paths: bool) -> DataFrame:
    """The records with what follows from their parents, which are placed already."""
    above = _above(placed, "parent", ["core", "kind", "weight", "top", *(["via"] if paths else [])])
    found = salted_join(taken, above if hot else above.hint("merge"), ["grp", "parent"], hot, ["id"])
    over = F.when(F.col("parent") == F.col("_core"), F.array().cast("array<bigint>")).otherwise(F.array("parent"))
    return found.select(
        *KEY, "origin", "own", F.col("_core").alias("core"), F.col("_kind").alias("kind"), (F.col("weight") + F.col("_weight")).alias("weight"), F.coalesce("_top", "top").alias("top"),
        *([F.concat("_via", over, "via").alias("via")] if paths else []), "kid", "step",
    )


def _on_circles(under: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, id) of the nodes on circles, of those ``under`` cores that are their own parent.

    A spliced node lies on the circle if the child it had does, which is a core, was spliced later
    itself, or raked; so children are followed, doubling the steps, until a core or the end.
    """
    cores = under.filter(F.col("step") == CORE).select(*KEY, _none().alias("kid"), F.lit(True).alias("on"))
    known = scratch.keep(cores.unionByName(under.filter(F.col("step") == SPLICE).select(*KEY, "kid", F.lit(None).cast("boolean").alias("on"))))
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        below = known.select("grp", F.col("id").alias("kid"), F.col("kid").alias("_kid"), F.col("on").alias("_on"), F.lit(True).alias("_met"))
        moved = known.filter("on is null").join(below.hint("merge"), ["grp", "kid"], "left")
        moved = moved.select(*KEY, F.col("_kid").alias("kid"), F.when(F.col("_met").isNull(), False).otherwise(F.col("_on")).alias("on"))
        before, known = known, scratch.keep(known.filter("on is not null").unionByName(moved).observe(seen, F.count_if(F.col("on").isNull()).alias("open")))
        scratch.drop(before)
        if not seen.get["open"]:
            return known.filter("on").select(*KEY)
    raise RuntimeError("a chain of children doesn't end")


def hierarchy(nodes: DataFrame, scratch: Scratch, total: int, *, paths: bool = True) -> DataFrame:
    """For each node of ``nodes`` (grp, id, parent): (grp, id, parent, root, depth, path, hangs, state).

    Trees are separate per ``grp``. ``state`` is ``rooted`` (depth 0 for a node whose parent is null
    or names no node), ``on_cycle`` or ``below_cycle``; only rooted nodes have a root, a depth and a
    path (root first, the node last). ``hangs`` is the same for a ``below_cycle`` node, from the
    circle node it hangs from. Without ``paths``, both are null.

    Rounds of unary-chain compression and leaf raking shrink the forest, each recording what it took
    out and from where, until only cores are left: roots, and nodes that are their own parent, which
    expose circles. Then the records are read backwards, from the last round to the first: a node
    follows the parent it had when it was taken out, which is placed by then. Records are tables in
    the scratch folder; the number of rounds grows with the logarithm of the number of nodes, and the
    last rounds, of few nodes, share tables. ``total`` is about the number of rows.

    Rows with a null id are left out, a null ``grp`` is not allowed. Of differing copies of a node
    the greatest non-null parent holds. An empty table gives no rows.
    """
    start = scratch.keep(_start(nodes.select(*KEY, "parent"), paths))
    written, circles = _contract(start, scratch, total, paths)
    if not written:
        written = [(start.filter("false"), 1)]
    # no parent gets more children than it has at the start, and a batch of rounds holds no hot one
    hot = hot_buckets(start.filter("origin is not null").select("grp", F.col("origin").alias("parent")), ["grp", "parent"], total)
    if hot is not None:
        hot.table = scratch.keep(hot.table)
    placed = [_cores(written, paths)]
    for table, rounds in reversed(written):
        taken = table.filter(F.col("step").isin(SPLICE, RAKE)).select(*KEY, "origin", "own", "parent", "weight", "top", *(["via"] if paths else []), "kid", "step")
        placed.append(scratch.keep(_place(_within(taken, rounds, paths), reduce(DataFrame.unionByName, placed), hot, paths)))
    every = reduce(DataFrame.unionByName, placed).filter("own = 1")

    ghost = F.col("kind") == GHOST
    none = F.lit(None).cast("array<bigint>")
    path = F.concat(F.when(ghost, F.array().cast("array<bigint>")).otherwise(F.array("core")), "via", F.when(F.col("id") == F.col("core"), F.array().cast("array<bigint>")).otherwise(F.array("id"))) if paths else none
    rooted = every.filter(F.col("kind") != CIRCLE).select(
        *KEY, F.col("origin").alias("parent"), F.when(ghost, F.col("top")).otherwise(F.col("core")).alias("root"), (F.col("weight") - F.when(ghost, 1).otherwise(0)).alias("depth"),
        path.alias("path"), none.alias("hangs"), F.lit("rooted").alias("state"),
    )
    if not circles:
        return rooted
    under = every.filter(F.col("kind") == CIRCLE)
    on = _on_circles(under, scratch).withColumn("_on", F.lit(True))
    lost = under.join(on.hint("merge"), KEY, "left").select(*KEY, "origin", "core", "kind", "_on", *(["via"] if paths else []))
    if paths:
        # the way down from the core begins on the circle: what follows its last node there hangs
        steps = lost.filter("_on is null").select(*KEY, path.alias("_way")).select(*KEY, "_way", F.posexplode("_way").alias("_at", "_step"))
        last = steps.join(on.select("grp", F.col("id").alias("_step")).hint("merge"), ["grp", "_step"]).groupBy(*KEY).agg(F.max("_at").alias("_at"), F.first("_way").alias("_way"))
        hangs = last.select(*KEY, F.slice("_way", F.col("_at") + 1, F.size("_way")).alias("hangs"))
        lost = lost.join(hangs.hint("merge"), KEY, "left")
    else:
        lost = lost.withColumn("hangs", none)
    state = F.when(F.col("_on"), "on_cycle").otherwise("below_cycle")
    return rooted.unionByName(lost.select(*KEY, F.col("origin").alias("parent"), _none().alias("root"), _none().alias("depth"), none.alias("path"), "hangs", state.alias("state")))


def descendants(placed: DataFrame) -> DataFrame:
    """(grp, ancestor, id, distance): every rooted node below each of its ancestors, from the paths of hierarchy()."""
    inner = placed.filter("state = 'rooted'").select("grp", "id", "depth", F.posexplode("path").alias("_at", "ancestor"))
    return inner.filter("_at < depth").select("grp", "ancestor", "id", (F.col("depth") - F.col("_at")).alias("distance"))


def hanging(placed: DataFrame) -> DataFrame:
    """(grp, ancestor, id, distance): every node below a circle with each node above it, up to the circle node it hangs from.

    So a circle node's descendants are the nodes that hang from it, not those that hang from other
    nodes of the circle; circle nodes are nobody's descendants, as each would be above and below all others.
    """
    inner = placed.filter("state = 'below_cycle'").select("grp", "id", F.size("hangs").cast("bigint").alias("_n"), F.posexplode("hangs").alias("_at", "ancestor"))
    return inner.filter("_at < _n - 1").select("grp", "ancestor", "id", (F.col("_n") - 1 - F.col("_at")).alias("distance"))
