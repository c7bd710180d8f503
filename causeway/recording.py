"""A recording as DataFrames: made of an event log, of the six tables, or read from Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.schema import EVENTS, TABLES
from causeway.scratch import Scratch
from causeway.skew import carry, shard_cuts

RUN = "run"
#: Added to the place of a poll that never ended, which counts as recorded last.
LATE = 1 << 62


@dataclass
class Recording:
    """The six tables, each with ``run_id``; ids are unique within a run and table."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    totals: dict[str, int] = field(default_factory=dict)
    #: Tables in which rows delivered twice still come twice.
    copies: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def total(self, name: str) -> int:
        """Rows of a table, as far as known from its source: an upper bound is enough."""
        if name not in self.totals:
            self.totals[name] = self.tables[name].count()
        return self.totals[name]

    def repeated(self, name: str) -> DataFrame:
        """A table for folds to which copies of a row don't matter: it may have some, and isn't moved to drop them."""
        return self.copies.get(name, self.tables[name])


def from_tables(spark: SparkSession, sf_dir: str, run_id: str = RUN) -> Recording:
    """The recording in a folder of Parquet tables.

    Rows delivered twice are one row: copies of tasks and resources give their first non-null values,
    the earliest start and the non-null end; exact copies elsewhere fall together. Rows without an
    id are left out.
    """
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    totals = {name: df.count() for name, df in read.items()}
    tables, copies = {}, {}
    for name, schema in TABLES.items():
        columns = [f.name for f in schema.fields if f.name not in ("run_id", "id")]
        df = read[name].dropna(subset=["id"])
        if name in ("tasks", "resources"):
            start = "spawn_ts" if name == "tasks" else "new_ts"
            df = df.groupBy("id").agg(*[(F.min if c == start else F.max)(c).alias(c) for c in columns])
        else:
            copies[name] = df.select(F.lit(run_id).alias("run_id"), "id", *columns)
            df = df.select("id", *columns).distinct()
        tables[name] = df.select(F.lit(run_id).alias("run_id"), "id", *columns)
    return Recording(spark, tables, totals, copies)


def from_records(spark: SparkSession, rows: list[dict], run_id: str = RUN) -> Recording:
    """A recording of event rows in memory, in order; for tests and small inputs."""
    full = [{"run_id": run_id, "seq": k, **r} for k, r in enumerate(rows)]
    return from_log(spark.createDataFrame([tuple(r.get(f.name) for f in EVENTS.fields) for r in full], EVENTS))


def _ended(spawned: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """The first end after the row exists; ends before it are lost."""
    first = (
        ends.select("run_id", "id", F.col("seq").alias("_end_seq"), F.col("ts").alias("_end_ts"))
        .join(spawned.select("run_id", "id", "_seq"), ["run_id", "id"])
        .filter("_end_seq > _seq")
        .groupBy("run_id", "id")
        .agg(F.min_by("_end_ts", "_end_seq").alias(name))
    )
    return spawned.join(first, ["run_id", "id"], "left").drop("_seq")


def from_log(log: DataFrame, total: int | None = None, scratch: Scratch | None = None) -> Recording:
    """The six tables of an event log (schema.EVENTS), by order of ``seq`` within each run.

    The first declaration of an id holds; the first end after it, too. A poll is a start directly
    followed by an end among the task's poll events: a later start replaces an open one, an end
    without a start is dropped, and the start left open gives a poll without end, last in order.
    ``id`` of polls, parks, wakes and states is their place in the log. With ``scratch``, the log and
    the tables are written there once, which pays if more than one query follows.
    """
    if scratch is not None:
        log = scratch.keep(log)
    total = log.count() if total is None else total
    of = lambda kind: log.filter(F.col("ev") == kind)

    def declared(kind: str, columns: list[str]) -> DataFrame:
        first = of(kind).groupBy("run_id", "id").agg(F.min_by(F.struct("seq", "ts", *columns), "seq").alias("_f"))
        return first.select("run_id", "id", *[F.col(f"_f.{c}").alias(c) for c in columns], F.col("_f.ts").alias("_ts"), F.col("_f.seq").alias("_seq"))

    tasks = declared("task_spawn", ["parent", "name", "kind", "loc_file", "loc_line"]).withColumnRenamed("_ts", "spawn_ts")
    resources = declared("resource_new", ["parent", "concrete_type", "loc_file", "loc_line", "is_internal"]).withColumnRenamed("_ts", "new_ts")

    marks = log.filter(F.col("ev").isin("poll_start", "poll_end")).select("run_id", "task", "seq", "ts", F.col("ev") == "poll_start")
    marks = marks.toDF("run_id", "task", "seq", "ts", "opens")
    keys = ["run_id", "task"]
    cuts = shard_cuts(marks, keys, ["seq"], total)
    this = F.struct("seq", "ts", "opens")
    # a start and what follows it, also in the next shard
    later = carry(marks, cuts, keys, ["seq"], F.min(this), F.last("_sum"), after=True)
    w = Window.partitionBy(*keys, "_shard").orderBy("seq")
    starts = later.withColumn("_next", F.coalesce(F.lead(this).over(w), F.col("_carry"))).filter("opens and (_next is null or not _next.opens)")
    polls = starts.select("run_id", F.coalesce("_next.seq", F.col("seq") + LATE).alias("id"), "task", F.col("ts").alias("start_ts"), F.col("_next.ts").alias("end_ts"))

    place = F.col("seq").alias("id")
    tables = {
        "tasks": _ended(tasks, of("task_end"), "end_ts"),
        "resources": _ended(resources, of("resource_drop"), "drop_ts"),
        "polls": polls,
        "parks": of("park").select("run_id", place, "task", "resource", "op_name", "ts"),
        "wakes": of("wake").select("run_id", place, "woken", "by", "ts"),
        "resource_state": of("resource_state").select("run_id", place, "resource", "field", "value", "op", "ts"),
    }
    tables = {name: tables[name].select(*TABLES[name].fieldNames()) for name in TABLES}
    if scratch is not None:
        tables = {name: scratch.keep(df) for name, df in tables.items()}
    return Recording(log.sparkSession, tables, dict.fromkeys(TABLES, total))
