"""Filling containers of fixed capacity by multiway differencing (problem 8)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers a chunk is meant to fill. A chunk wastes about half a container by rounding up.
CHUNK_CONTAINERS = 96
#: Items a chunk is meant to have at most, however small they are.
CHUNK_ITEMS = 16_384


def difference(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for ``ways`` windows: (window of each item, sum of each window).

    Each item begins as a partition of its own, with one window filled. The two partitions of the
    largest imbalance are merged, largest windows onto smallest, until one is left; which windows met
    is recorded and followed back from the last merge. Partitions hold their filled windows only, in
    falling order, while fewer than ``ways`` are filled. Ties go by position, so equal input gives
    equal output.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(ways, np.int64)
    filled: list[np.ndarray | None] = [np.array([s], np.int64) for s in sizes]
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def spread(x: np.ndarray) -> int:
        return int(x[0] - x[-1]) if len(x) == ways else int(x[0])

    heap = [(-spread(x), k) for k, x in enumerate(filled)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = filled[a], filled[b]
        filled[a] = filled[b] = None
        # y reversed: its largest windows lie on the smallest, or empty, ones of x
        width = min(ways, len(x) + len(y))
        total = np.zeros(width, np.int64)
        total[: len(x)] += x
        total[width - len(y) :] += y[::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty(width, np.int32)
        place[order] = np.arange(width, dtype=np.int32)
        # where each window of a and b went
        made.append((a, b, place[: len(x)], place[width - len(y) :][::-1]))
        filled.append(total[order])
        heapq.heappush(heap, (-spread(filled[-1]), len(filled) - 1))
    root = heap[0][1]
    sums = np.zeros(ways, np.int64)
    sums[: len(filled[root])] = filled[root]
    where: dict[int, np.ndarray] = {root: np.arange(len(filled[root]), dtype=np.int32)}
    for k in range(len(made) - 1, -1, -1):
        a, b, of_a, of_b = made[k]
        at = where.pop(n + k)
        where[a], where[b] = at[of_a], at[of_b]
    return np.array([where[k][0] for k in range(n)], np.int64), sums


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the windows needed: for any small size t, items above capacity - t share with none of at least t."""
    if len(sizes) == 0:
        return 1
    x = np.sort(sizes)
    ahead = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity / 2, "right")
    t = np.concatenate([[0], x[:half]])
    alone = np.searchsorted(x, capacity - t, "right")
    small = np.searchsorted(x, t, "left")
    single = len(x) - alone
    mid = alone - half
    room = mid * capacity - (ahead[alone] - ahead[half])
    extra = np.ceil(np.maximum(0, (ahead[half] - ahead[small]) - room) / capacity)
    return max(1, int((single + mid + extra).max()))


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, windows): as few near-equal windows as differencing finds; none exceeds the capacity."""
    ways, step = least_windows(sizes, capacity), 1
    while True:
        windows, sums = difference(sizes, ways)
        if int(sums.max(initial=0)) <= capacity:
            return windows, ways
        ways += step
        step = max(1, ways // 64)


def pack_documents(lengths: DataFrame, capacities: DataFrame, *, seed: int = 0, chunk_containers: int = CHUNK_CONTAINERS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """(pack_name, container, doc_id, piece, start_token, tokens): every document in containers of every capacity.

    ``lengths`` has doc_id (unique) and tokens, ``capacities`` pack_name and capacity_tokens. A
    document that doesn't exceed a capacity is one piece in one container; one that does is cut into
    full containers of its own and a rest, which is packed like a document. Documents of 0 tokens,
    null ones included, need no container and aren't in the result. ``container`` is unique within
    pack_name.

    Items are dealt by a hash of their id to chunks meant to fill ``chunk_containers`` containers, with
    about ``chunk_items`` items at most, whatever their number, source or page, and each chunk is packed by itself; so work grows with the
    number of documents, and no group does. A capacity that is null or not positive is an error. No
    documents, no rows.
    """
    lengths = lengths.filter("tokens > 0 and doc_id is not null").select("doc_id", F.col("tokens").cast("bigint").alias("_all"))
    wanted = [(r.pack_name, r.capacity_tokens) for r in capacities.select("pack_name", "capacity_tokens").distinct().collect()]
    if any(c is None or c <= 0 for _, c in wanted):
        raise ValueError("capacities are positive")
    if not wanted:
        raise ValueError("no capacity")
    whole = lengths.agg(*[F.sum(F.col("_all") % c) for _, c in wanted], *[F.count_if(F.col("_all") % c > 0) for _, c in wanted]).first()
    chunks = [max(1, math.ceil((whole[k] or 0) / (c * chunk_containers)), math.ceil(whole[len(wanted) + k] / chunk_items)) for k, (_, c) in enumerate(wanted)]
    packs = [
        F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity"), F.lit(chunks[k]).alias("chunks"))
        for k, (name, c) in enumerate(wanted)
    ]
    items = lengths.select("doc_id", "_all", F.explode(F.array(*packs)).alias("_p")).select("doc_id", "_all", "_p.*")
    items = items.select("pack_name", "capacity", "doc_id", "_all", F.floor(F.col("_all") / F.col("capacity")).alias("_full"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("chunks")).cast("int").alias("chunk"))
    full = items.filter("_full > 0").select("pack_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)).alias("piece"))
    full = full.select(
        "pack_name", F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens")
    )
    rest = items.filter("_all > _full * capacity").select("pack_name", "capacity", "chunk", "doc_id", F.col("_full").cast("int").alias("piece"), (F.col("_all") - F.col("_full") * F.col("capacity")).alias("tokens"))

    def fill(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        windows, _ = pack(chunk["tokens"].to_numpy(np.int64), int(chunk["capacity"].iloc[0]))
        return pd.DataFrame(
            {
                "pack_name": chunk["pack_name"],
                "container": [f"c{c}-{w}" for c, w in zip(chunk["chunk"], windows)],
                "doc_id": chunk["doc_id"],
                "piece": chunk["piece"],
                "start_token": chunk["piece"].astype("int64") * chunk["capacity"],
                "tokens": chunk["tokens"],
            }
        )

    packed = rest.groupBy("pack_name", "chunk").applyInPandas(fill, "pack_name string, container string, doc_id bigint, piece int, start_token bigint, tokens bigint")
    return full.unionByName(packed)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill): how full each capacity's containers are."""
    # tokens per container first: the largest group of the second step is a capacity's containers, combined before the shuffle
    each = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return total.join(capacities.select("pack_name", "capacity_tokens").distinct(), "pack_name").select("pack_name", "capacity_tokens", "containers", "tokens", fill.alias("fill"))
