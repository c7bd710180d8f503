"""Percentiles of very large numeric columns from mergeable bucket counts (problem 2).

A value v falls into the bucket (sign, index) with index = ceil(log(|v|) / log(g)),
g = (1 + a) / (1 - a); zero has a bucket of its own. Answering a bucket with 2 g**index / (g + 1)
is at most a factor a off every value in it, so any percentile has a relative error of at most a.
Counts of equal buckets add up, so sketches of pieces (partitions, days) merge without loss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.01


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value's bucket as one number that sorts like the values: null for null and NaN.

    Positive values get index + OFFSET, negative ones its negative, zero 0. Infinite values get the
    ends of the scale.
    """
    log_g = math.log(_gamma(error))
    size = F.abs(value.cast("double"))
    index = F.when(size == float("inf"), F.lit(_far(error))).otherwise(F.ceil(F.log(size) / F.lit(log_g)) + F.lit(_offset(error)))
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(None)).when(value == 0, F.lit(0)).when(value > 0, index).otherwise(-index).cast("int")


def _offset(error: float) -> int:
    """Above the index of the smallest double, so that every shifted index is positive."""
    return math.ceil(1075 * math.log(2) / math.log(_gamma(error))) + 1


def _far(error: float) -> int:
    return 2 * _offset(error)


def bucket_value(index: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value that answers for a bucket."""
    g = _gamma(error)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.abs(index) - F.lit(_offset(error)))
    far = F.lit(float("inf"))
    return F.when(index == 0, F.lit(0.0)).otherwise(F.signum(index.cast("double")) * F.when(F.abs(index) == _far(error), far).otherwise(size))


def sketch(rows: DataFrame, by: list[str], value: Column, error: float = RELATIVE_ERROR) -> DataFrame:
    """(by..., bucket, n): the sketch of each group, counted partially before the shuffle.

    Null and NaN values are left out; a null group is a group. A group has at most some thousand
    buckets however many rows it has, so a hot group ends in no large task. No rows, no sketch.
    """
    counted = rows.select(*by, bucket(value, error).alias("bucket")).filter("bucket is not null")
    return counted.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of groups ``by``, put together from those of pieces or finer groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], at: list[float], error: float = RELATIVE_ERROR) -> DataFrame:
    """(by..., q, n, value): for each group and q of ``at``, the value of rank floor(q * (n - 1)) from 0.

    ``value`` is within ``error`` times the true one of that rank, plus or minus.
    """
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("percentiles lie between 0 and 1")
    # a group's buckets are bounded by the scale, so its window is
    w = Window.partitionBy(*by)
    up_to = F.sum("n").over(w.orderBy("bucket"))
    placed = sketches.withColumn("_up_to", up_to).withColumn("_all", F.sum("n").over(w))
    ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor(F.lit(float(q)) * (F.col("_all") - 1)).alias("rank")) for q in at])
    hit = F.filter(ranks, lambda r: (r["rank"] < F.col("_up_to")) & (r["rank"] >= F.col("_up_to") - F.col("n")))
    hits = placed.withColumn("_hit", F.explode(hit))
    return hits.select(*by, F.col("_hit.q").alias("q"), F.col("_all").alias("n"), bucket_value(F.col("bucket"), error).alias("value"))
