"""The spawn tree in pre-order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.labels import task_label
from causeway.operators.hierarchy import hierarchy
from causeway.recording import Recording
from causeway.scratch import Scratch


def spawn_tree(rec: Recording, scratch: Scratch) -> DataFrame:
    """(run_id, task, depth, path, label): sorted by run_id and ``place``, a tree in spawn order, children under their parents.

    A task whose parent is missing, or itself, is a root; tasks whose parents run in a circle come
    without a depth and place, last.
    """
    nodes = rec.tasks.select(F.col("run_id").alias("grp"), "id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"))
    placed = hierarchy(nodes, scratch, rec.total("tasks"))
    times = rec.tasks.select(F.col("run_id").alias("grp"), F.col("id").alias("_step"), F.col("spawn_ts").alias("_at"))
    steps = placed.select("grp", "id", F.posexplode("path").alias("_no", "_step")).join(times, ["grp", "_step"])
    place = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", F.format_string("%020d.%020d", "_at", "_step").alias("s")))), lambda x: x["s"]), "/")
    order = steps.groupBy("grp", "id").agg(place.alias("place"))
    label = task_label(F.col("name"), F.col("kind"), F.col("loc_file"), F.col("loc_line"), F.col("id"))
    named = rec.tasks.select(F.col("run_id").alias("grp"), "id", label.alias("label"))
    full = placed.join(order, ["grp", "id"], "left").join(named, ["grp", "id"])
    return full.select(F.col("grp").alias("run_id"), F.col("id").alias("task"), "depth", F.array_join("path", "/").alias("path"), "label", "place")
