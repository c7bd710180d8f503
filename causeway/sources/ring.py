"""A recording with known deadlocks, made of the star-schema tables: one ring of locks per region.

Each nation's task takes its own lock, then waits for the next nation's in its region. Suppliers wait
behind a nation; even customers for a lock that an idle task of the region holds, odd ones for a
channel without a holder. Each region is a run of its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from causeway.recording import Recording, from_log
from causeway.schema import EVENTS
from causeway.scratch import Scratch
from causeway.tables import table

#: (task, time, resource, act) of all tasks, in SQL that both engines read.
ACTS = """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name, CAST(n_regionkey AS BIGINT) AS rg,
    CAST(coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS BIGINT) AS nx FROM nation)
SELECT rg, k + 1 AS task, n_name AS name, 1000 * k + 100 AS t, 1000 + k AS res, 'acquired_by' AS act FROM n
UNION ALL SELECT rg, k + 1, n_name, 100000 + 1000 * k, 1000 + nx, 'park' FROM n
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 500 + CAST(r_regionkey AS BIGINT), concat('holder-', r_regionkey), 50000 + 10 * CAST(r_regionkey AS BIGINT), 5000 + CAST(r_regionkey AS BIGINT), 'acquired_by' FROM region
UNION ALL SELECT n.rg, 10000 + s_suppkey, s_name, 200000 + 10 * s_suppkey, 1000 + CAST(s_nationkey AS BIGINT), 'park' FROM supplier JOIN n ON s_nationkey = n.k
UNION ALL SELECT n.rg, 1000000 + c_custkey, c_name, 1000000 + 10 * c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 5000 + n.rg ELSE 6000 END, 'park' FROM customer JOIN n ON c_nationkey = n.k"""


def ring_recording(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None) -> Recording:
    for name in ("nation", "region", "supplier", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    acts = spark.sql(ACTS).withColumn("run_id", F.concat(F.lit("region-"), "rg"))

    def event(df, **columns):
        given = {c: F.lit(None).cast(EVENTS[c].dataType) for c in EVENTS.fieldNames()} | columns
        return df.select(*[c.cast(EVENTS[n].dataType).alias(n) for n, c in given.items()])

    t, run, zero = F.col("t"), F.col("run_id"), F.lit(0)
    tasks = acts.select("run_id", "task", "name").distinct()
    locks = acts.filter("res <> 6000").select("run_id", F.col("res").alias("r"), (F.col("res") % 1000).alias("k")).distinct()
    line = F.when(F.col("r") >= 5000, F.col("k") + 100).otherwise(F.col("k"))
    runs = acts.select("run_id").distinct()
    permits = F.explode(F.array(*[F.struct(F.lit(k).alias("no"), F.lit(v).alias("v"), F.lit(o).alias("o")) for k, v, o in ((1, 2, "override"), (2, 1, "sub"), (3, 1, "sub"))]))
    channel = runs.withColumn("p", permits)
    parts = [
        event(tasks, run_id=run, seq=F.col("task") - (1 << 40), ts=zero, ev=F.lit("task_spawn"), id=F.col("task"), name=F.col("name"), kind=F.lit("task"), loc_file=F.lit("ring.rs"), loc_line=F.lit(1)),
        event(locks, run_id=run, seq=F.col("r") - (1 << 41), ts=zero, ev=F.lit("resource_new"), id=F.col("r"), concrete_type=F.lit("Mutex"), loc_file=F.lit("ring.rs"), loc_line=line, is_internal=F.lit(False)),
        event(runs, run_id=run, seq=F.lit(6000 - (1 << 41)), ts=zero, ev=F.lit("resource_new"), id=F.lit(6000), concrete_type=F.lit("mpsc::channel"), loc_file=F.lit("ring.rs"), loc_line=F.lit(999), is_internal=F.lit(False)),
        event(channel, run_id=run, seq=F.col("p.no") - (1 << 39), ts=F.col("p.no"), ev=F.lit("resource_state"), resource=F.lit(6000), field=F.lit("permits"), value=F.col("p.v"), op=F.col("p.o")),
        event(acts, run_id=run, seq=t * 8 + 1, ts=t, ev=F.lit("poll_start"), task=F.col("task")),
        event(acts.filter("act = 'park'"), run_id=run, seq=t * 8 + 2, ts=t + 1, ev=F.lit("park"), task=F.col("task"), resource=F.col("res"), op_name=F.lit("poll_acquire")),
        event(acts.filter("act <> 'park'"), run_id=run, seq=t * 8 + 2, ts=t + 1, ev=F.lit("resource_state"), resource=F.col("res"), field=F.lit("acquired_by"), value=F.col("task"), op=F.lit("override")),
        event(acts, run_id=run, seq=t * 8 + 3, ts=t + 2, ev=F.lit("poll_end"), task=F.col("task")),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return from_log(log, scratch=scratch)
