"""The registered queries of the llm subpackage: problems 2 and 7 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.names import plain_name
from causeway.llm.mixing import mixture, weighted_lengths
from causeway.llm.packing import fill_report, pack_documents
from causeway.llm.percentiles import merge, percentiles, sketch
from causeway.llm.quality import common_words, text_quality
from causeway.llm.runs import collapse_runs
from causeway.llm.tokens import token_counts
from causeway.operators.features import one_per_id
from causeway.scratch import Scratch
from causeway.tables import table

QUANTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
#: Stretch of start_ts for which a sketch of its own is made, ns.
PERIOD_NS = 60_000_000_000
#: Error of the buckets; what is left of percentiles.RELATIVE_ERROR pays for rounding the answers.
SKETCH_ERROR = 0.009


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "polls").withColumn("took", F.col("end_ts") - F.col("start_ts"))
    return one_per_id(polls, "id", "task", "start_ts", "took")


def _answers(found: DataFrame, scope: str, *by: str) -> DataFrame:
    """Answers to some digits, which with SKETCH_ERROR stay within RELATIVE_ERROR of whole numbers."""
    whole = F.expr("CASE WHEN abs(value) >= 1000 THEN round(value) ELSE round(value, 3) END AS value")
    return found.select(F.lit(scope).alias("scope"), (F.col(by[0]) if by else F.lit(None).cast("bigint")).alias("key"), F.col("q"), "n", whole)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = sketch(_durations(spark, sf_dir), ["task"], F.col("took"), SKETCH_ERROR)
    each = _answers(percentiles(tasks, ["task"], QUANTILES, SKETCH_ERROR), "task", "task")
    return each.union(_answers(percentiles(merge(tasks, []), [], QUANTILES, SKETCH_ERROR), "all"))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch for each stretch of start_ts, and what they give when put together."""
    start = F.col("start_ts") - F.pmod(F.col("start_ts"), F.lit(PERIOD_NS))
    pieces = sketch(_durations(spark, sf_dir).withColumn("period", start), ["period"], F.col("took"), SKETCH_ERROR)
    each = _answers(percentiles(pieces, ["period"], QUANTILES, SKETCH_ERROR), "period", "period")
    return each.union(_answers(percentiles(merge(pieces, []), [], QUANTILES, SKETCH_ERROR), "all"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parks = table(spark, sf_dir, "parks")
    return collapse_runs(
        parks, Scratch(spark), parks.count(), entity="task", row_id="id", ts="ts", alike=[F.col("resource"), plain_name(F.col("op_name"))]
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("entity").alias("task"), "first_id", "last_id")


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumnRenamed("entity", "task")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, made once and read by all that follows."""
    return Scratch(spark).keep(token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_lengths(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_packing(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    common = common_words(table(spark, sf_dir, "common_words"))
    weighted = weighted_lengths(table(spark, sf_dir, "documents"), common)
    return mixture(Scratch(spark).keep(weighted), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), common_words(table(spark, sf_dir, "common_words")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).filter("not is_prose").select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (p2_percentiles, p2_periods, p7_found, p7_runs, p8_packing, p8_fill, p9_mixture, p9_shares, p10_found, p10_statistics)
}
