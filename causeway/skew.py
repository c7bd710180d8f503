"""Keys that hold a large share of a table: finding them, salting joins, ordered shards.

A unit of work holds a bounded number of rows: ``UNIT_FLOOR`` in small tables, in larger ones a
1/``MAX_CUTS`` share, but never more than ``UNIT_MOST``, however large the table is. What is
broadcast has a bound, too: at most ``BUCKETS`` salts, and at most ``MAX_CUTS`` shard bounds twice
over. A table with more units than that is cut by a range partitioning instead, without a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from causeway.scratch import Scratch

UNIT_FLOOR = 50_000
UNIT_MOST = 4_000_000
#: Units of a table up to which the bounds of its hot keys' shards are broadcast.
MAX_CUTS = 65_536
#: Hash buckets by which joins are salted.
BUCKETS = 1 << 18
#: Sampled rows per shard from which its bounds are taken.
SAMPLES_PER_UNIT = 32


def unit_rows(total: int, floor: int | None = None) -> int:
    """Rows that one unit of work may hold."""
    floor = UNIT_FLOOR if floor is None else floor
    return max(floor, min(UNIT_MOST, -(-total // MAX_CUTS)))


@dataclass
class Salts:
    """Hash buckets of keys with more than a unit of rows: (_bucket, _units), at most BUCKETS rows."""

    table: DataFrame
    keys: list[str]

    def spread(self, df: DataFrame, keys: list[str]) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        return df.withColumn("_bucket", bucket).join(F.broadcast(self.table), "_bucket", "left").drop("_bucket")


def hot_buckets(rows: DataFrame, keys: list[str], total: int, floor: int | None = None) -> Salts | None:
    """Where ``rows`` are crowded by ``keys``, for salted_join; None if ``total`` rows fit into one unit.

    Counted per bucket of the keys' hash, so the result is bounded whatever the number of hot keys.
    """
    unit = unit_rows(total, floor)
    if total <= unit:
        return None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    counts = rows.dropna(subset=keys).groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    return Salts(counts.filter(F.col("_n") > unit).select("_bucket", F.ceil(F.col("_n") / F.lit(unit)).cast("int").alias("_units")), keys)


def salted_join(rows: DataFrame, dims: DataFrame, keys: list[str], hot: Salts | None, salt_by: list[str], how: str = "inner", *, keep_salt: bool = False) -> DataFrame:
    """Join many ``rows`` per key to ``dims`` (one row per key) with crowded buckets spread over salts.

    ``hot`` is the result of hot_buckets on the same keys; dims rows of a crowded bucket are repeated
    once per salt. With ``keep_salt`` the result has ``_salt``, as it lies by keys and salt.
    """
    if hot is None:
        joined = rows.join(dims, keys, how)
        return joined.withColumn("_salt", F.lit(0)) if keep_salt else joined
    salt = F.when(F.col("_units").isNotNull(), F.pmod(F.xxhash64(*salt_by), F.col("_units")).cast("int")).otherwise(F.lit(0))
    spread = hot.spread(rows, keys).withColumn("_salt", salt).drop("_units")
    copied = hot.spread(dims, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_units", F.lit(1)) - 1))).drop("_units")
    joined = spread.join(copied, [*keys, "_salt"], how)
    return joined if keep_salt else joined.drop("_salt")


@dataclass
class Cuts:
    """How the rows of hot keys are cut into ordered shards.

    ``table`` has the keys and ``_cuts``, where shards begin (all but the first); without it, all rows
    are cut into ``parts`` ranges of (key, order).
    """

    table: DataFrame | None = None
    parts: int = 0


def shard_cuts(rows: DataFrame, key: str | list[str], order: list[str], total: int, floor: int | None = None) -> Cuts | None:
    """Cuts for the hot keys of ``rows``; None if the table is too small for any.

    Cuts are places in the ``order`` columns; if the last of them is unique within the key, ties are
    split too. They come from a hash sample of the hot keys' rows, about MAX_CUTS *
    SAMPLES_PER_UNIT rows at most; they only balance the shards, every row is kept.
    """
    keys = [key] if isinstance(key, str) else key
    unit = unit_rows(total, floor)
    if total <= unit:
        return None
    if total > unit * MAX_CUTS:
        return Cuts(parts=-(-total // unit))
    hot = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > unit)
    # at most MAX_CUTS keys have a unit of rows
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / F.lit(unit)).cast("int").alias("_units")))
    every = max(1, unit // SAMPLES_PER_UNIT)
    sampled = rows.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*keys, F.struct(*order).alias("_at")).join(hot, keys)
    samples = sampled.groupBy(*keys, "_units").agg(F.array_sort(F.collect_list("_at")).alias("_all"))
    pick = F.transform(
        F.sequence(F.lit(1), F.col("_units") - 1),
        lambda i: F.element_at("_all", F.greatest(F.lit(1), F.floor(i * F.size("_all") / F.col("_units")).cast("int"))),
    )
    return Cuts(samples.filter("_units > 1").select(*keys, pick.alias("_cuts")))


def _passed(cuts: str, at: Column) -> Column:
    """How many of the sorted ``cuts`` don't lie behind ``at``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range((2 * MAX_CUTS).bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(cuts)) & (F.get(F.col(cuts), n + s - 1) <= at), n + s).otherwise(n))


def assign_shards(rows: DataFrame, cuts: Cuts | None, key: str | list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_shard`` and ``_hot``: shards of a key follow each other in ``order``; a key that is not hot has one shard only.

    Rows equal in key and order come into the same shard.
    """
    keys = [key] if isinstance(key, str) else key
    if cuts is None:
        return rows.withColumn("_hot", F.lit(False)).withColumn("_shard", F.lit(0))
    if cuts.table is None:
        # read more than once, and a partition's number means nothing but in the run that made it
        ranged = rows.repartitionByRange(cuts.parts, *keys, *order)
        return Scratch(rows.sparkSession).keep(ranged.withColumn("_hot", F.lit(True)).withColumn("_shard", F.spark_partition_id()))
    return (
        rows.join(F.broadcast(cuts.table), keys, "left")
        .withColumn("_hot", F.col("_cuts").isNotNull())
        .withColumn("_shard", F.when(F.col("_hot"), _passed("_cuts", F.struct(*order))).otherwise(F.lit(0)))
        .drop("_cuts")
    )


def by_shard(df: DataFrame, cuts: Cuts) -> DataFrame:
    """A table with a row per shard of hot keys, marked for broadcast where their number has a bound."""
    return df if cuts.table is None else F.broadcast(df)


def carry(rows: DataFrame, cuts: Cuts | None, key: str | list[str], order: list[str], summary: Column, over: Column | Callable[[WindowSpec], Column], *, after: bool = False) -> DataFrame:
    """``rows`` in their shards, with ``_carry``: what comes from the key's earlier (or later) shards.

    ``summary`` aggregates a shard's rows to ``_sum``; ``over`` (an aggregate, or a function of the
    window) folds the ``_sum`` of all earlier shards, nearest last (with ``after``: later ones,
    nearest last too). Only hot keys have other shards.
    """
    keys = [key] if isinstance(key, str) else key
    fold = over.over if isinstance(over, Column) else over
    sharded = assign_shards(rows, cuts, keys, order)
    if cuts is None:
        kind = rows.sparkSession.createDataFrame([], rows.schema).groupBy(*keys).agg(summary.alias("_sum")).withColumn("_x", fold(Window.partitionBy(*keys).orderBy(*keys))).schema["_x"].dataType
        return sharded.withColumn("_carry", F.lit(None).cast(kind))
    hot = sharded if cuts.table is None else assign_shards(rows.join(F.broadcast(cuts.table.select(*keys)), keys, "left_semi"), cuts, keys, order)
    sums = hot.groupBy(*keys, "_shard").agg(summary.alias("_sum"))
    place = F.col("_shard").desc() if after else F.col("_shard").asc()
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return sharded.join(by_shard(sums.select(*keys, "_shard", fold(w).alias("_carry")), cuts), [*keys, "_shard"], "left")
