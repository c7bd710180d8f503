"""Many runs of one program: which deadlocks were seen or foreseen, and in which runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.labels import resource_label
from causeway.plans.folds import ends_of
from causeway.plans.lint import circles
from causeway.plans.predict import predict
from causeway.recording import Recording
from causeway.scratch import Scratch


def _keyed(rec: Recording, cycles: DataFrame, column: str) -> DataFrame:
    """Cycles by the labels of their resources, sorted, each once."""
    inner = cycles.select("run_id", F.col(column).alias("_c"), F.explode(column).alias("resource"))
    label = resource_label(F.col("concrete_type"), F.col("loc_file"), F.col("loc_line"), F.col("resource"))
    named = inner.join(rec.resources.withColumnRenamed("id", "resource"), ["run_id", "resource"], "left").select("run_id", "_c", label.alias("label"))
    return named.groupBy("run_id", "_c").agg(F.array_join(F.array_sort(F.collect_set("label")), "→").alias("key")).select("run_id", "key").distinct()


def hunt_cycles(rec: Recording, scratch: Scratch) -> DataFrame:
    """(key, observed, predicted, observed_runs, predicted_runs, first_run): each cycle over all runs, most observed first when sorted so."""
    ends = scratch.keep(ends_of(rec))
    seen = _keyed(rec, circles(rec, ends, scratch), "resources")
    best = scratch.keep(predict(rec, ends, scratch)[0])
    # a foreseen cycle that is a deadlock at the run's end counts as seen only
    seen = seen.unionByName(_keyed(rec, best.filter("observed"), "path")).distinct().withColumn("seen", F.lit(True))
    foreseen = _keyed(rec, best.filter("not observed"), "path").withColumn("seen", F.lit(False))
    both = seen.unionByName(foreseen)
    runs = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("run_id")))), ",")
    return both.groupBy("key").agg(
        F.count_if("seen").alias("observed"), F.count_if(~F.col("seen")).alias("predicted"), runs(F.col("seen")).alias("observed_runs"), runs(~F.col("seen")).alias("predicted_runs"), F.min("run_id").alias("first_run")
    )


def verdict(found: DataFrame, hung: int = 0) -> int:
    """2 if a run hung or deadlocked, 1 if a deadlock is latent, else 0."""
    seen = found.agg(F.max(F.when(F.col("observed") > 0, 2).otherwise(1))).first()[0]
    return 2 if hung else seen or 0
