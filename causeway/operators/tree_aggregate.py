"""Per-key results without one unit of work holding a hot key (problem 4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.scratch import Scratch
from causeway.skew import UNIT_FLOOR, carry, shard_cuts

#: How each kind of state is taken from rows and merged.
MERGE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def tree_aggregate(
    rows: DataFrame, keys: list[str], row_id: str, states: dict[str, tuple[str, str]], total: int, *, chunk_rows: int = 65_536, fan_in: int = 8
) -> DataFrame:
    """Per-key states of all rows (one per ``row_id``), merged in a tree of bounded fan-in.

    ``states`` maps a result column to (kind, source column), kind one of count, sum, min, max.
    Rows are dealt to chunks of about ``chunk_rows`` by a hash of their id, in step with the shuffle
    that drops copies, so a chunk's rows lie together and are combined where they are; round by
    round, states of ``fan_in`` neighbouring chunks meet, until one node is left. No reducer gets
    more than ``fan_in`` partial states of a key, whatever share of the rows the key has.

    Rows with a null id are left out; a null key is a key. Copies of an id count once, with the
    greatest non-null value of each column. An empty table gives no rows.
    """
    spark = rows.sparkSession
    sources = sorted({s for k, s in states.values() if k != "count"})
    once = rows.dropna(subset=[row_id]).groupBy(row_id).agg(*[F.max(c).alias(c) for c in [*keys, *(s for s in sources if s not in keys)]])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_part = max(1, math.ceil(total / chunk_rows / parts))
    nodes = parts * per_part
    slot = F.pmod(F.hash(row_id), F.lit(nodes))
    # chunks of one shuffle partition are neighbours: partition = slot mod parts
    node = F.pmod(slot, F.lit(parts)) * per_part + F.floor(slot / parts)
    level = once.withColumn("_node", F.floor(node / fan_in).cast("int"))
    made = {
        name: (F.count(F.lit(1)) if kind == "count" else MERGE[kind](source)).alias(name) for name, (kind, source) in states.items()
    }
    level = level.groupBy("_node", *keys).agg(*made.values())
    width = math.ceil(nodes / fan_in)
    while width > 1:
        level = level.withColumn("_node", F.floor(F.col("_node") / fan_in).cast("int")).groupBy("_node", *keys)
        level = level.agg(*[MERGE[kind](name).alias(name) for name, (kind, _) in states.items()])
        width = math.ceil(width / fan_in)
    return level.drop("_node")


def heavy_keys(rows: DataFrame, key: str, row_id: str, share: float, total: int, scratch: Scratch) -> DataFrame:
    """(key_value, n): the non-null keys that hold at least ``share`` of the rows (ids)."""
    counts = scratch.keep(tree_aggregate(rows.select(row_id, key), [key], row_id, {"n": ("count", row_id)}, total))
    held = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter((F.col("n") >= share * held) & F.col(key).isNotNull()).select(F.col(key).alias("key_value"), "n")


def order_within_key(rows: DataFrame, key: str, order: list[str], row_id: str, total: int, floor: int = UNIT_FLOOR) -> DataFrame:
    """(row_id, key, pos): each row's place, from 1, in its key's rows by ``order``, then ``row_id``.

    Hot keys are cut into ordered shards (skew.shard_cuts); a shard's rows are numbered in place
    and the sizes of earlier shards added. Rows with a null key or id are left out, copies count once;
    null order values come first.
    """
    wanted = [c for c in order if c != row_id]
    once = rows.dropna(subset=[key, row_id]).groupBy(row_id).agg(*[F.max(c).alias(c) for c in dict.fromkeys([key, *wanted])])
    source = rows.select(*dict.fromkeys([row_id, key, *wanted])).dropna(subset=[key, row_id])
    place = [*wanted, row_id]
    cuts = shard_cuts(source, key, place, total, floor)
    sharded = carry(once, cuts, key, place, F.count(F.lit(1)), F.sum("_sum"))
    w = Window.partitionBy(key, "_shard").orderBy(*place)
    return sharded.select(row_id, key, (F.row_number().over(w) + F.coalesce("_carry", F.lit(0))).alias("pos"))
