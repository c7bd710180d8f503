"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.quality import Scorer, _pieces
from causeway.llm.tokens import TOKENIZER_DIR, VOCABULARY, counter
from causeway.skew import carry, shard_cuts

#: Weight of a text without prose; all prose has 1. Weights steer chances, they exclude nothing.
LEAST_WEIGHT = 0.1
#: Documents a shard of a source is meant to hold while keys are put in order, in small tables.
SLICE_ROWS = 50_000
#: A list of sources is small by nature; a longer one is refused.
MOST_SOURCES = 10_000


def weighted_lengths(documents: DataFrame, common: list[tuple[str, str]], *, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, tokens, weight): length and quality weight of each text, in one pass.

    The weight is the share of prose, from LEAST_WEIGHT up. Null and empty texts have 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, count = Scorer(common), counter(path).of
        for batch in batches:
            for piece in _pieces(batch):
                share = scorer.score(piece.column(1))["prose_share"]
                tokens = [count(t) for t in piece.column(1).to_pylist()]
                weight = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * share
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(tokens, pa.int64()), pa.array(weight)], names=["doc_id", "source", "tokens", "weight"])

    return documents.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, source string, tokens bigint, weight double")


def budgets(available: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None) -> dict[str, tuple[float, int, int]]:
    """source -> (share among the sources that have tokens, whole epochs, tokens beyond them).

    Shares of sources without tokens are divided among the others in proportion. Without
    ``total_tokens`` the mixture is as large as it can be with every share reached; with it, a source
    that cannot reach its share within its repeats gives all it may.
    """
    usable = [(s, share, repeats) for s, share, repeats in targets if available.get(s, 0) > 0 and share > 0 and repeats > 0]
    whole = sum(share for _, share, _ in usable)
    if not usable:
        return {}
    if total_tokens is None:
        total_tokens = int(min(available[s] * repeats * whole / share for s, share, repeats in usable))
    found = {}
    for s, share, repeats in usable:
        wanted = min(int(total_tokens * share / whole), available[s] * repeats)
        found[s] = (share / whole, wanted // available[s], wanted % available[s])
    return found


def mixture(lengths: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 0, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, repeats) and the report of its shares.

    ``lengths`` has doc_id (unique), source, tokens, weight; ``targets`` source, target_share and
    max_repeats. Each source's budget is taken in complete epochs, then the rest by weighted sampling
    without replacement: a document's key is an exponential draw (from a hash of its id and the seed)
    divided by its weight, keys are put in order within the source, and documents are taken while the
    sum of tokens up to and with them stays within the rest. So a document is used as often as there
    are epochs, or once more, at most ``max_repeats`` times, and a source ends less than one
    document short of its budget.

    A source with many documents is ordered in shards whose bounds are taken from a sample of its own
    keys, so they are even whatever the weights; the sums of earlier shards are added up, and no task
    holds a source. Documents with a null or unlisted source or 0 tokens
    are not used; a weight that is null, zero or less counts as the least one. Of target rows that
    repeat a source the greatest share holds. The report has a row per listed source: (source,
    target_share, available_tokens, budget_tokens, tokens, documents, actual_share,
    most_repeats). Without documents the mixture is empty and actual shares are null.
    """
    spark = lengths.sparkSession
    wanted = targets.dropna().groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    listed = wanted.limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    usable = lengths.filter("tokens > 0 and doc_id is not null and source is not null")
    counted = usable.join(F.broadcast(wanted.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    found = {r.source: (r.t, r.n) for r in counted.collect()}
    plan = budgets({s: t for s, (t, _) in found.items()}, [(r.source, r.target_share, r.max_repeats) for r in listed], total_tokens)
    rows = [
        (r.source, float(r.target_share), found.get(r.source, (0, 0))[0], *(plan.get(r.source) or (0.0, 0, 0))[1:])
        for r in listed
    ]
    budget = spark.createDataFrame(rows, "source string, target_share double, available_tokens bigint, epochs bigint, rest bigint")

    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.when(F.col("weight") >= LEAST_WEIGHT, F.col("weight")).otherwise(F.lit(LEAST_WEIGHT))
    # at most MOST_SOURCES rows
    keyed = usable.join(F.broadcast(budget.filter("epochs > 0 or rest > 0")), "source").withColumn("_key", -F.log(draw) / weight)
    keyed = keyed.select("doc_id", "source", "tokens", "epochs", "rest", "_key")
    place = ["_key", "doc_id"]
    cuts = shard_cuts(keyed, "source", place, sum(n for _, n in found.values()), slice_rows)
    sliced = carry(keyed, cuts, "source", place, F.sum("tokens"), F.sum("_sum"))
    w = Window.partitionBy("source", "_shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("_upto", F.coalesce("_carry", F.lit(0)) + F.sum("tokens").over(w))
    repeats = F.col("epochs") + (F.col("_upto") <= F.col("rest")).cast("bigint")
    mixed = placed.select("doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")

    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("documents"), F.max("repeats").alias("most_repeats"))
    zero = F.lit(0).cast("bigint")
    report = F.broadcast(budget).join(used, "source", "left").select(
        "source",
        "target_share",
        "available_tokens",
        (F.col("epochs") * F.col("available_tokens") + F.col("rest")).alias("budget_tokens"),
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("documents", zero).alias("documents"),
        F.coalesce("most_repeats", zero).alias("most_repeats"),
        F.lit(1).alias("_one"),
    )
    # one row per listed source
    report = report.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("_one")), zero)).drop("_one")
    return mixed, report
