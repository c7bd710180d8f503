"""References to records that do not exist at the referring time (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.skew import hot_buckets, salted_join


def broken_references(
    rows: DataFrame, parents: DataFrame, *, ref: str, row_id: str, ts: str, total: int, parent_id: str = "id", since: str | None = None, until: str | None = None
) -> DataFrame:
    """(row_id, ts, reason): the rows whose ``ref`` names no parent, or one not yet or no longer there.

    ``reason`` is ``missing`` without a parent row of that id, ``ended`` if ``ts`` is greater than
    the parent's ``until``, else ``not_yet`` if it is less than its ``since``; null times break
    nothing. The distinct non-null references, with their first and last time (combined before the
    shuffle), are anti-joined with the parents' ids, and compared with the parents' times; only the
    references found so are joined back to the rows, hot ones over salts.

    Copies of a parent are one row: its earliest ``since`` and the non-null ``until`` hold. Copies of
    a row give one row. Rows with a null reference or id are no case. An empty parent table makes
    every reference missing.
    """
    bounds = [(F.min(since) if since else F.lit(None).cast("bigint")).alias("_since"), (F.max(until) if until else F.lit(None).cast("bigint")).alias("_until")]
    known = parents.select(F.col(parent_id).alias("_ref"), *[c for c in (since, until) if c]).dropna(subset=["_ref"]).groupBy("_ref").agg(*bounds)
    facts = rows.select(F.col(ref).alias("_ref"), F.col(row_id).alias("row_id"), F.col(ts).alias("ts")).dropna(subset=["_ref", "row_id"])
    named = facts.groupBy("_ref").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    orphans = named.join(known, "_ref", "left_anti").select("_ref", F.lit(True).alias("_missing"), F.lit(None).cast("bigint").alias("_since"), F.lit(None).cast("bigint").alias("_until"))
    timed = named.join(known, "_ref").filter("_last > _until or _first < _since").select("_ref", F.lit(False).alias("_missing"), "_since", "_until")
    hot = hot_buckets(facts, ["_ref"], total)
    found = salted_join(facts, orphans.union(timed), ["_ref"], hot, ["row_id"])
    reason = F.when(F.col("_missing"), "missing").when(F.col("ts") > F.col("_until"), "ended").when(F.col("ts") < F.col("_since"), "not_yet")
    return found.select("row_id", "ts", reason.alias("reason")).filter("reason is not null").distinct()


def per_period(found: DataFrame, period: int, *by: str) -> DataFrame:
    """Counts of ``found`` by ``by``, reason and stretch of ``ts`` (its start, a multiple of ``period``)."""
    start = F.col("ts") - F.pmod(F.col("ts"), F.lit(period))
    return found.groupBy(*by, "reason", start.alias("period_start")).agg(F.count(F.lit(1)).alias("n"))
