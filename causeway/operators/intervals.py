"""Continuous periods and the gaps between them (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.skew import UNIT_FLOOR, assign_shards, by_shard, shard_cuts


def busy_periods(
    rows: DataFrame, entity: str, row_id: str, total: int, *, start: str = "start_ts", end: str = "end_ts", floor: int = UNIT_FLOOR
) -> DataFrame:
    """(entity, start_ts, end_ts, n, free_since): each entity's longest continuous covered stretches.

    ``n`` is the number of intervals (ids) in the period; ``free_since`` the end of the period before
    it, null for the first, so [free_since, start_ts] is the gap ahead of it. Intervals that touch
    belong together, and one of length 0 counts.

    Two levels for huge entities: a hot entity's intervals fall into time shards by their start (bounds
    from skew.shard_cuts). Each is clipped where the next shard begins, and what the intervals of
    earlier shards leave over for a shard enters it as one piece, clipped as well: the furthest of
    them covers all others. A shard is merged locally; then the pieces that touch shard bounds are
    stitched per entity, at most two a shard, and coalesced.

    Rows with a null entity, id, start or end, or an end before the start, are left out; copies of
    an id count once. An empty table gives no rows.
    """
    usable = rows.select(
        F.col(entity).alias("entity"), F.col(row_id).alias("_id"), F.col(start).alias("_start"), F.col(end).alias("_end")
    ).filter("entity is not null and _id is not null and _start is not null and _end >= _start")
    place = ["_start", "_id"]
    cuts = shard_cuts(usable, "entity", place, total, floor)
    once = usable.groupBy("_id").agg(*[F.max(c).alias(c) for c in ("entity", "_start", "_end")])
    sharded = assign_shards(once, cuts, "entity", place).withColumn("_count", F.lit(1))
    local = sharded.select("entity", "_shard", "_hot", "_start", "_end", "_id", "_count")
    if cuts is not None:
        each = sharded.filter("_hot").groupBy("entity", "_shard").agg(F.min("_start").alias("_since"), F.max("_end").alias("_far"))
        order = Window.partitionBy("entity").orderBy("_shard")
        each = each.withColumn("_until", F.lead("_since").over(order)).withColumn("_left", F.max("_far").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        clip = by_shard(each.select("entity", "_shard", "_until"), cuts)
        local = local.join(clip, ["entity", "_shard"], "left").withColumn("_end", F.least("_end", "_until")).drop("_until")
        entering = each.filter("_left >= _since").select(
            "entity", "_shard", F.lit(True).alias("_hot"), F.col("_since").alias("_start"), F.least("_left", "_until").alias("_end"), F.lit(None).cast(local.schema["_id"].dataType).alias("_id"), F.lit(0).alias("_count")
        )
        local = local.unionByName(entering)
    w = Window.partitionBy("entity", "_shard").orderBy("_start", "_id")
    cover = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    local = local.withColumn("_cover", cover).withColumn("_opens", F.col("_cover").isNull() | (F.col("_start") > F.col("_cover")))
    local = local.withColumn("_no", F.sum(F.col("_opens").cast("int")).over(w))
    pieces = local.groupBy("entity", "_shard", "_hot", "_no").agg(
        F.min("_start").alias("start_ts"),
        F.max("_end").alias("end_ts"),
        F.sum("_count").alias("n"),
        F.max(F.when(F.col("_opens"), F.col("_cover"))).alias("free_since"),
    )
    if cuts is None:
        return pieces.select("entity", "start_ts", "end_ts", "n", "free_since")
    last = F.lead("_no").over(Window.partitionBy("entity", "_shard").orderBy("_no")).isNull()
    pieces = pieces.withColumn("_bound", F.col("_hot") & ((F.col("_no") == 1) | last))
    done = pieces.filter("not _bound").select("entity", "start_ts", "end_ts", "n", "free_since")
    chain = Window.partitionBy("entity").orderBy("_shard", "_no")
    met = F.max("end_ts").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    bound = pieces.filter("_bound").withColumn("_met", met)
    # the piece before one of a shard's later pieces lies in the shard, that before its first in an earlier one
    opens = (F.col("_no") > 1) | F.col("_met").isNull() | (F.col("start_ts") > F.col("_met"))
    bound = bound.withColumn("free_since", F.when(opens, F.coalesce("free_since", "_met"))).withColumn("_period", F.sum(opens.cast("int")).over(chain))
    stitched = bound.groupBy("entity", "_period").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n"), F.max("free_since").alias("free_since")
    )
    return done.unionByName(stitched.drop("_period"))


def periods_and_gaps(periods: DataFrame, *, least_n: int = 1, least_gap: int = 0, most_gap: int | None = None) -> DataFrame:
    """(entity, span_kind, start_ts, end_ts) from busy_periods: ``period`` of at least ``least_n`` intervals, ``gap`` within the bounds."""
    length = F.col("start_ts") - F.col("free_since")
    wanted = (length >= least_gap) & (length <= most_gap if most_gap is not None else F.lit(True))
    spans = F.array(
        F.when(F.col("n") >= least_n, F.struct(F.lit("period").alias("span_kind"), F.col("start_ts"), F.col("end_ts"))),
        F.when(wanted, F.struct(F.lit("gap").alias("span_kind"), F.col("free_since").alias("start_ts"), F.col("start_ts").alias("end_ts"))),
    )
    return periods.select("entity", F.explode(F.array_compact(spans)).alias("_s")).select("entity", "_s.span_kind", "_s.start_ts", "_s.end_ts")
