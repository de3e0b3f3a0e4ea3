"""Problem 8: items put whole into containers of a fixed capacity with little room left.

Method: Karmarkar-Karp multiway differencing. Every item starts as a partition of its own with
all its weight in one window; the two partitions with the largest differences are merged with
the heavy windows of one on the light windows of the other, until one partition is left, whose
windows are nearly equal. If one of them exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.llm.tokens import RANKS, token_counts
from remeasure.session import stored

CAPACITY = 8192
#: Items packed together in one task; each such lot leaves at most about one container part-filled.
LOT = 2048


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to windows - 1) of each item, by multiway differencing.

    A partition keeps its windows' weights in falling order, less the smallest of them; windows
    without weight aren't stored while there are less than ``windows``.
    """
    n = len(sizes)
    if windows <= 1:
        return np.zeros(n, np.int64)
    parent = list(range(n))  # windows merged into one are chained, named by one of their items
    order = np.argsort(-sizes, kind="stable")
    heap = [(-float(sizes[i]), int(t), np.array([sizes[i]], float), np.array([i])) for t, i in enumerate(order)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        overlap = len(a) + len(b) - windows
        if overlap > 0:
            # the lightest of a take the heaviest of b
            own, other = len(a) - overlap, overlap
            joined = a[own:] + b[:other][::-1]
            for x, y in zip(ia[own:].tolist(), ib[:other][::-1].tolist()):
                parent[y] = x
            weight = np.concatenate([a[:own], joined, b[other:]])
            item = np.concatenate([ia[:own], ia[own:], ib[other:]])
        else:
            weight, item = np.concatenate([a, b]), np.concatenate([ia, ib])
        rank = np.argsort(-weight, kind="stable")
        weight, item = weight[rank], item[rank]
        if len(weight) == windows:
            weight = weight - weight[-1]
        heapq.heappush(heap, (-float(weight[0]), tick, weight, item))
        tick += 1
    roots = np.full(n, -1)
    roots[heap[0][3]] = np.arange(len(heap[0][3]))
    for i in range(n):
        chain = [i]
        while parent[chain[-1]] != chain[-1]:
            chain.append(parent[chain[-1]])
        roots[chain] = roots[chain[-1]]
        for x in chain:
            parent[x] = chain[-1]
    return roots


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, no window above ``capacity``; items must not exceed it.

    The number of windows starts at what the total needs and rises, in growing steps, until
    nothing exceeds the capacity; the gap that the last step left is then halved.
    """
    total = int(sizes.sum())
    low = max(1, -(-total // capacity))

    def tried(k: int) -> np.ndarray | None:
        at = differencing(sizes, k)
        return at if np.bincount(at, sizes, minlength=1).max(initial=0) <= capacity else None

    k, step, fails = low, 1, low - 1
    while (best := tried(k)) is None:
        fails = k
        k, step = k + step, step * 2
    while k - fails > 1:
        middle = (k + fails) // 2
        if (at := tried(middle)) is None:
            fails = middle
        else:
            k, best = middle, at
    return best


def _pack_lot(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["n_tokens", "doc_id", "text_hash", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        sizes = lot["n_tokens"].to_numpy(np.int64)
        window = np.zeros(len(lot), np.int64)
        some = sizes > 0
        if some.any():
            window[some] = pack(sizes[some], capacity)
        return lot.assign(window=window)

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, ranks_path: str = RANKS, lot: int = LOT) -> DataFrame:
    """(container, doc_id, piece, start_token, n_tokens): where every document goes.

    A document of at most ``capacity`` tokens is one piece (0). A larger one is cut into pieces of
    exactly the capacity, each a full container, and a rest that is packed like any other item.
    Null and empty texts have one piece of 0 tokens. Repeated rows are packed as often as they
    occur; no rows give no containers. container is a string, ``lot-window`` or, for a full one,
    ``full-`` with the document, its text's hash, the number of the copy and the piece; it depends on
    the rows alone, not on how they lie in files.

    Items are dealt by hash over lots of about ``lot`` items, each packed in one task by differencing.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = _copies(stored(token_counts(documents, ranks_path)))
    last = F.greatest(F.expr(f"(n_tokens - 1) div {capacity}"), F.lit(0)).alias("last")
    full = rows.select("*", last).where("last > 0").withColumn("piece", F.explode(F.expr("sequence(0L, last - 1)")))
    name = F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("text_hash"), "copy", "piece")
    full = full.select(name.alias("container"), "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    rest = rows.select("doc_id", "text_hash", "copy", last, "n_tokens").select("doc_id", "text_hash", "copy", F.col("last").alias("piece"), (F.col("n_tokens") - F.col("last") * capacity).alias("n_tokens"))
    lots = max(1, -(-rows.count() // lot))
    dealt = rest.withColumn("lot", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", F.lit("lot")), F.lit(lots)))
    # lots are small in bytes and dear in time: their tasks are spread by number, not merged by size
    tasks = min(lots, max(2 * rows.sparkSession.sparkContext.defaultParallelism, lots // 64))
    schema = "doc_id bigint, text_hash bigint, copy bigint, piece bigint, n_tokens bigint, lot bigint, window bigint"
    packed = dealt.repartition(tasks, "lot").groupBy("lot").applyInPandas(_pack_lot(capacity), schema)
    packed = packed.select(F.concat_ws("-", "lot", "window").alias("container"), "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), "n_tokens")
    return full.unionByName(packed)


#: Copies of one row that are numbered in one task.
COPIES = 100_000


def _copies(sized: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens, copy): every row, equal rows numbered from 0.

    Equal rows are counted and their numbers made anew, in runs of COPIES, so that a row that occurs
    very often fills no task.
    """
    key = ["doc_id", "text_hash", "n_tokens"]
    counts = sized.groupBy(*key).agg(F.count("*").alias("n"))
    runs = counts.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition(*key, "run")
    numbers = F.expr(f"sequence(run * {COPIES}, least((run + 1) * {COPIES}, n) - 1)")
    return stored(runs.select(*key, F.explode(numbers).alias("copy")))


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, used, unused) of every container."""
    used = packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used"))
    return used.withColumn("unused", F.lit(capacity).cast("bigint") - F.col("used"))


def packing_report(documents: DataFrame, capacity: int = CAPACITY, ranks_path: str = RANKS, lot: int = LOT, waste: float = 0.03) -> DataFrame:
    """One row: n_documents (packed rows), n_over_capacity (containers), n_divided_that_fit (documents) and is_tight.

    is_tight: there are at most as many containers as the tokens need with ``waste`` of the room left
    over, and one more for each lot, whose last one is rarely full.
    """
    packed = stored(pack_documents(documents, capacity, ranks_path, lot))
    held = container_report(packed, capacity)
    tokens, rows = F.sum("used"), F.sum("n_items")
    containers = held.agg(F.count("*").alias("n_containers"), F.count_if(F.col("used") > capacity).alias("n_over_capacity"), tokens.alias("tokens"), rows.alias("items")).withColumn("k", F.lit(1))
    # more pieces than copies, though all of them together would fit into one container
    short = packed.groupBy("doc_id").agg(F.count_if(F.col("piece") > 0).alias("cuts"), F.sum("n_tokens").alias("n")).where((F.col("cuts") > 0) & (F.col("n") <= capacity))
    first = packed.where("piece = 0").agg(F.count("*").alias("n_documents")).withColumn("k", F.lit(1))
    apart = short.agg(F.count("*").alias("n_divided_that_fit")).withColumn("k", F.lit(1))
    joined = containers.join(first, "k").join(apart, "k")
    allowed = F.ceil(F.coalesce("tokens", F.lit(0)) / (capacity * (1 - waste))) + F.ceil(F.col("n_documents") / lot)
    return joined.select("n_documents", "n_over_capacity", "n_divided_that_fit", (F.col("n_containers") <= allowed).alias("is_tight"))
