"""Items packed into containers of fixed capacity by Karmarkar-Karp multiway differencing.

Each task packs the stream of its own input in groups of about ``group_windows`` containers, so no
row is shuffled: texts are measured where they are read. Within a group, partial partitions with
opposing imbalances are merged (largest difference first, heaviest bin onto lightest), which gives
near-equal windows; the number of windows starts at the lower bound and rises while one exceeds
the capacity. Texts above the capacity are divided; only their last part is left to pack.

NULL texts are left out; empty texts are items of size 0; repeated rows are items of their own.
Container ids are unique, not consecutive, and depend on how the input is split into tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPLIT, VOCABULARY, tokenizer


def difference(sizes: list[int], bins: int) -> tuple[np.ndarray, int]:
    """(bin of each item, largest bin) by multiway differencing."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    sums: list[np.ndarray] = []
    kids: list[tuple] = []
    heap: list[tuple[int, int]] = []

    def add(total: np.ndarray, kid: tuple) -> None:
        at = np.argsort(-total, kind="stable")
        sums.append(total[at])
        kids.append((*kid, at))
        heapq.heappush(heap, (-int(total.max() - total.min()), len(sums) - 1))

    for item in order:  # the first level: each item alone, all other bins empty
        total = np.zeros(bins, dtype=np.int64)
        total[0] = sizes[item]
        add(total, ("item", item))
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        add(sums[x] + sums[y][::-1], ("pair", x, y))
    where = np.zeros(len(sizes), dtype=np.int64)
    root = heap[0][1]
    stack = [(root, np.arange(bins))]
    while stack:  # names: the bin of each sorted position of the node
        node, names = stack.pop()
        kid = kids[node]
        plain = np.empty(bins, dtype=np.int64)
        plain[kid[-1]] = names
        if kid[0] == "item":
            where[kid[1]] = plain[0]
        else:
            stack += [(kid[1], plain), (kid[2], plain[::-1])]
    return where, int(sums[root][0])


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """Container of each item; every size is at most ``capacity``."""
    if not sizes:
        return np.zeros(0, dtype=np.int64)
    total = sum(sizes)
    bins = max(1, -(-total // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        where, largest = difference(sizes, bins)
        if largest <= capacity:
            return where
        bins += max(1, bins // 100)


SCHEMA = "container_id long, doc_id long, part int, start long, stop long, tokens long"


def fill_containers(
    docs: DataFrame, capacity: int, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = SPLIT, group_windows: int = 128
) -> DataFrame:
    """(container_id, doc_id, part, start, stop, tokens): every text, or part of one, in a container.

    ``start`` and ``stop`` are character positions. A group closes at ``group_windows`` times the
    capacity; a task's last group may be smaller, which costs at most one partly filled container.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tok = tokenizer(vocabulary, pattern)
        serial = TaskContext.get().partitionId() << 36
        group: list[tuple] = []
        full: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal serial, size
            where = pack([g[-1] for g in group], capacity)
            # windows without an item cannot occur: bins <= items unless all sizes are 0
            rows = [(serial + int(w), *g) for w, g in zip(where, group, strict=True)]
            serial += int(where.max()) + 1 if len(where) else 0
            for g in full:
                rows.append((serial, *g))
                serial += 1
            group.clear()
            full.clear()
            size = 0
            return pd.DataFrame(rows, columns=names)

        for b in batches:
            for i, x in zip(b["id"], b["text"], strict=True):
                n = tok.count(x)
                parts = [(0, len(x), n)] if n <= capacity else tok.divide(x, capacity)
                for k, (s, e, m) in enumerate(parts):
                    if m >= capacity:
                        full.append((i, k, s, e, m))
                    else:
                        group.append((i, k, s, e, m))
                        size += m
                if size >= group_windows * capacity:
                    yield flush()
        if group or full:
            yield flush()

    return docs.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and the share of the capacity in use."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("largest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("fill"),
    )
