"""The registered queries of the core: problems 1 and 3 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.names import plain_name
from causeway.operators.features import entity_features
from causeway.operators.hierarchy import descendants, hanging, hierarchy
from causeway.operators.intervals import busy_periods, periods_and_gaps
from causeway.operators.references import broken_references, per_period
from causeway.operators.tree_aggregate import heavy_keys, order_within_key, tree_aggregate
from causeway.scratch import Scratch
from causeway.tables import table

#: Length of a reporting period, ns.
PERIOD_NS = 60_000_000_000
HEAVY_SHARE = 0.02


def catalog_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed list of kinds; its size does not depend on the recording."""
    return sorted(r.op_name for r in table(spark, sf_dir, "op_catalog").select("op_name").dropna().distinct().collect())


def p1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_features(
        table(spark, sf_dir, "tasks"),
        table(spark, sf_dir, "parks"),
        catalog_names(spark, sf_dir),
        type_key=plain_name,
        spans=table(spark, sf_dir, "polls"),
    )


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, resources = table(spark, sf_dir, "tasks"), table(spark, sf_dir, "resources")
    found = None
    for name, ref, ts, parents, since, until in (
        ("parks", "resource", "ts", resources, "new_ts", "drop_ts"),
        ("parks", "task", "ts", tasks, "spawn_ts", "end_ts"),
        ("polls", "task", "start_ts", tasks, "spawn_ts", "end_ts"),
    ):
        rows = table(spark, sf_dir, name)
        part = broken_references(rows, parents, ref=ref, row_id="id", ts=ts, since=since, until=until, total=rows.count())
        part = part.select(F.lit(name).alias("table_name"), F.lit(ref).alias("ref_field"), "row_id", "reason", "ts")
        found = part if found is None else found.union(part)
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).drop("ts")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_period(_references(spark, sf_dir), PERIOD_NS, "table_name", "ref_field")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, scratch = None, Scratch(spark)
    for name, key in (("polls", "task"), ("parks", "resource")):
        rows = table(spark, sf_dir, name)
        part = heavy_keys(rows, key, "id", HEAVY_SHARE, rows.count(), scratch)
        part = part.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_field"), "key_value")
        found = part if found is None else found.union(part)
    return found


def p4_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls, parks = table(spark, sf_dir, "polls"), table(spark, sf_dir, "parks")
    spent = F.when(F.col("end_ts") >= F.col("start_ts"), F.col("end_ts") - F.col("start_ts")).otherwise(F.lit(0))
    states = {"n": ("count", "id"), "total_ns": ("sum", "spent"), "last_ts": ("max", "at")}
    found = None
    for name, key, rows, total in (
        ("polls", "task", polls.select("id", "task", spent.alias("spent"), F.col("start_ts").alias("at")), polls.count()),
        ("parks", "resource", parks.select("id", "resource", F.lit(0).cast("bigint").alias("spent"), F.col("ts").alias("at")), parks.count()),
    ):
        part = tree_aggregate(rows, [key], "id", states, total)
        part = part.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_field"), F.col(key).alias("key_value"), *states)
        found = part if found is None else found.union(part)
    return found


def p4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polls; p4_order_all has the parks, too."""
    polls = table(spark, sf_dir, "polls")
    return order_within_key(polls, "task", ["start_ts"], "id", polls.count())


def p4_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name, key, ts in (("polls", "task", "start_ts"), ("parks", "resource", "ts")):
        rows = table(spark, sf_dir, name)
        part = order_within_key(rows, key, [ts], "id", rows.count())
        part = part.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_field"), "id", F.col(key).alias("key_value"), "pos")
        found = part if found is None else found.union(part)
    return found


def _hierarchy(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    tables = {name: table(spark, sf_dir, name).select("id", "parent") for name in ("tasks", "resources")}
    nodes = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("grp"), "id", "parent")
        nodes = part if nodes is None else nodes.union(part)
    return hierarchy(nodes, Scratch(spark), sum(t.count() for t in tables.values()), paths=paths)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _hierarchy(spark, sf_dir, paths=False).filter("state <> 'rooted'")
    return placed.select(F.col("grp").alias("table_name"), F.col("id").alias("node_id"), F.col("state").alias("node_state"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _hierarchy(spark, sf_dir, paths=True)
    return placed.select(F.col("grp").alias("table_name"), F.col("id").alias("node_id"), "root", "depth", F.array_join("path", "/").alias("path"), F.col("state").alias("node_state"))


def _pairs(below: DataFrame) -> DataFrame:
    return below.select(F.col("grp").alias("table_name"), "ancestor", F.col("id").alias("node_id"), "distance")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rooted nodes; p5_descendants_all has those below circles, too."""
    return _pairs(descendants(_hierarchy(spark, sf_dir, paths=True)))


def p5_descendants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _hierarchy(spark, sf_dir, paths=True)
    return _pairs(descendants(placed).unionByName(hanging(placed)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "polls")
    spans = periods_and_gaps(busy_periods(polls, "task", "id", polls.count()), least_n=2, least_gap=50_000_000, most_gap=20_000_000_000)
    return spans.withColumnRenamed("entity", "task")


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "polls")
    return periods_and_gaps(busy_periods(polls, "task", "id", polls.count())).withColumnRenamed("entity", "task")


QUERIES = {
    q.__name__: q
    for q in (p1_features, p3_found, p3_report, p4_found, p4_key_totals, p4_order, p4_order_all, p5_found, p5_hierarchy, p5_descendants, p5_descendants_all, p6_found, p6_periods)
}
