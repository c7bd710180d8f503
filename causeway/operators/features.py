"""One wide row per entity from its events (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More types than this would not fit a row of sensible width.
MAX_TYPES = 2_000


def one_per_id(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """One row per non-null ``id_col``; of differing copies the greatest non-null value of each column holds."""
    return df.dropna(subset=[id_col]).groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns])


def entity_features(
    entities: DataFrame,
    events: DataFrame,
    types: list[str],
    *,
    entity_id: str = "id",
    event_id: str = "id",
    event_entity: str = "task",
    event_type: str = "op_name",
    event_ts: str = "ts",
    type_key=lambda c: c,
    spans: DataFrame | None = None,
    span_start: str = "start_ts",
    span_end: str = "end_ts",
) -> DataFrame:
    """One row per entity: for each type its number of events and last time, and its spans' count and total time.

    ``types`` is the fixed list of types; ``type_key`` maps a type's spelling to the form by which
    types are compared (identity by default). Events of no listed type, null ones included, are
    counted as ``other``. ``spans`` (optional) adds ``n_spans`` and ``span_time``: spans without an
    end or with one before the start count, but add no time.

    Events are first combined per (entity, type) - partially before the shuffle, so that an entity
    or type with a third of all events sends a few rows per input split - and only these at most
    ``len(types) + 1`` rows per entity meet the wide conditional expressions, behind the shuffle.

    Rows sharing an id are one row. Entities without events have counts 0 and null times; events of
    a null or unlisted entity are left out. Empty tables give no rows (entities) or zeros (events).
    Columns beyond those named are ignored, whatever their names.
    """
    if len(types) > MAX_TYPES:
        raise ValueError(f"{len(types)} types; at most {MAX_TYPES}")
    spark = entities.sparkSession
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(types)], "name string, type_no int")
    listed = listed.groupBy(type_key(F.col("name")).alias("_key")).agg(F.min("type_no").alias("_type"))

    named = events.select(
        F.col(event_id).alias("_event"), F.col(event_entity).alias("_entity"), type_key(F.col(event_type)).alias("_key"), F.col(event_ts).alias("_ts")
    )
    # the list of types is bounded by MAX_TYPES
    typed = named.join(F.broadcast(listed), "_key", "left").select("_event", "_entity", F.coalesce("_type", F.lit(len(types))).alias("_type"), "_ts")
    kinds = (
        one_per_id(typed, "_event", "_entity", "_type", "_ts")
        .dropna(subset=["_entity"])
        .groupBy("_entity", "_type")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_ts").alias("_last"))
    )
    none = F.lit(None).cast("bigint")
    parts = kinds.select("_entity", "_type", "_n", "_last", none.alias("_time"))
    if spans is not None:
        length = F.when(F.col(span_end) >= F.col(span_start), F.col(span_end) - F.col(span_start))
        lengths = spans.select(F.col(event_id).alias("_span"), F.col(event_entity).alias("_entity"), length.alias("_time"))
        totals = (
            one_per_id(lengths, "_span", "_entity", "_time")
            .dropna(subset=["_entity"])
            .groupBy("_entity")
            .agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_time"), F.lit(0)).alias("_time"))
        )
        parts = parts.union(totals.select("_entity", F.lit(-1), "_n", none, "_time"))
    # each entity's own row, which also keeps those without events
    own = entities.select(F.col(entity_id).alias("_entity")).dropna().distinct()
    parts = parts.union(own.select("_entity", F.lit(-2), F.lit(0).cast("bigint"), none, none))

    # conditional aggregates by the type's number: one place per type, filled as rows come, whose
    # cost follows the rows an entity has and not the number of types
    slots = [-2, *([-1] if spans is not None else []), *range(len(types) + 1)]
    states = parts.repartition("_entity").groupBy("_entity").pivot("_type", slots)
    states = states.agg(F.sum("_n").alias("n"), F.max("_last").alias("last"), F.max("_time").alias("time"))
    # as text: some hundred columns are built far faster than through the column functions
    wide = [f"_entity AS `{entity_id}`"]
    for k, name in [*enumerate(types), (len(types), "other")]:
        column = name.replace("`", "``")
        wide += [f"coalesce(`{k}_n`, 0L) AS `n_{column}`", f"`{k}_last` AS `last_{column}`"]
    if spans is not None:
        wide += ["coalesce(`-1_n`, 0L) AS n_spans", "coalesce(`-1_time`, 0L) AS span_time"]
    return states.filter("`-2_n` IS NOT NULL").selectExpr(*wide)
