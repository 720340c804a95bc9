"""A mixture in which each source has its target share of all tokens, by min-cost flow.

Texts are the records: copies of one text are one record that belongs to every source it occurs
in, so that copies do not undercut the cap on repetitions. Records are aggregated by membership
pattern (the set of their sources); the patterns' tokens are the supply, the sources' quotas the
demand, and each further use of a record costs more than the one before (convex), so that the flow
repeats as little as possible. The graph has at most patterns + sources nodes and is solved on the
driver; its size is checked. Records are then chosen by a seeded position on each pattern's ring.

Records whose source is NULL or has no weight are left out; a weighted source without records
gets share 0; NULL texts and texts without tokens are left out. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tokens import SPLIT, VOCABULARY, tokenizer

#: Ring positions per pattern: selection is exact to 1/BUCKETS of a pattern's tokens.
BUCKETS = 4096
#: Patterns and weighted sources that the driver's flow graph holds at most; it is an error, not a cut, beyond that.
MAX_PATTERNS, MAX_SOURCES = 20_000, 1_000


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, source, digest, tokens); the texts themselves stop here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(vocabulary, pattern)
        for b in batches:
            b["tokens"] = [tok.count(x) for x in b.pop("text")]
            yield b

    narrow = docs.select("doc_id", "source", F.md5(F.to_binary("text", F.lit("utf-8"))).alias("digest"), "text")
    return narrow.mapInPandas(run, "doc_id long, source string, digest string, tokens long")


def min_cost_flow(supply: list[int], quota: list[int], member: list[list[int]], repeats: list[int]) -> list[dict[int, int]]:
    """flow[p][s]: tokens of pattern p for source s, most flow first, then least repetition.

    Use k of a pattern's tokens costs k. Successive cheapest paths; the graph is small.
    """
    np_, ns = len(supply), len(quota)
    src, sink = np_ + ns, np_ + ns + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
        return len(to) - 2

    arcs: dict[tuple[int, int], int] = {}
    for p in range(np_):
        for k in range(max(repeats[s] for s in member[p])):
            edge(src, p, supply[p], k * k)
        for s in member[p]:
            arcs[p, s] = edge(p, np_ + s, supply[p] * repeats[s], 0)
    for s in range(ns):
        edge(np_ + s, sink, quota[s], 0)
    while True:
        dist = [math.inf] * (sink + 1)
        via = [-1] * (sink + 1)
        dist[src] = 0
        queue = [src]
        while queue:
            nxt = []
            for x in queue:
                for e in out[x]:
                    if cap[e] and dist[x] + cost[e] < dist[to[e]]:
                        dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                        nxt.append(to[e])
            queue = list(dict.fromkeys(nxt))
        if dist[sink] == math.inf:
            break
        push, x = math.inf, sink
        while x != src:
            push, x = min(push, cap[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != src:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return [{s: cap[arcs[p, s] ^ 1] for s in member[p] if cap[arcs[p, s] ^ 1]} for p in range(np_)]


def _best_size(supply: list[int], share: list[float], member: list[list[int]], repeats: list[int]) -> int:
    """The largest total of which every present source can get its share (bisection over the flow)."""
    present = sorted({s for m in member for s in m})
    if not any(share[s] > 0 for s in present):
        return 0
    # sources without records have no part in what is used, so the total may exceed it
    lo, hi = 0, math.ceil(sum(n * max(repeats[s] for s in m) for n, m in zip(supply, member, strict=True)) / sum(share[s] for s in present))
    while hi - lo > hi // 10_000:
        mid = (lo + hi + 1) // 2
        quota = [int(mid * share[s]) if s in present else 0 for s in range(len(share))]
        got = sum(sum(f.values()) for f in min_cost_flow(supply, quota, member, repeats))
        lo, hi = (mid, hi) if got >= sum(quota) else (lo, mid - 1)
    return lo


def mix(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> DataFrame:
    """(doc_id, source, tokens, uses): the records of the mixture and how often each is used.

    ``total_tokens`` is the size of the mixture; by default the largest size at which every source
    that has records can have its share. With a larger size, sources end at their repetition cap.
    ``weights`` is a small table of sources, targets and caps; at most MAX_SOURCES are accepted.
    """
    spec = weights.where("source is not null and target_share > 0").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(spec) > MAX_SOURCES:
        raise ValueError("too many weighted sources for one flow graph")
    names = [r.source for r in spec]
    share, repeats = [float(r.target_share) for r in spec], [max(1, r.max_repeats or 1) for r in spec]
    kept = docs.where(F.col("text").isNotNull() & F.col("source").isin(names))
    per_source = token_counts(kept, vocabulary, pattern).groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    # at most one row per record and source reaches this list
    records = per_source.where("tokens > 0").groupBy("digest").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("held"))
    records = records.withColumn("pattern", F.array_join("held.source", "\u0001")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(BUCKETS)).cast("int"))
    records = cut_lineage(records)
    patterns = [r.pattern for r in records.select("pattern").distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError("too many combinations of sources for one flow graph")
    hist: dict[str, dict[int, int]] = {p: {} for p in patterns}
    for r in records.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n")).collect():  # <= MAX_PATTERNS * BUCKETS rows
        hist[r.pattern][r.bucket] = r.n
    member = [[names.index(x) for x in p.split("\u0001")] for p in patterns]
    supply = [sum(hist[p].values()) for p in patterns]
    total = _best_size(supply, share, member, repeats) if total_tokens is None else total_tokens
    flow = min_cost_flow(supply, [int(total * x) for x in share], member, repeats)

    rows: list[tuple] = []  # (pattern, source, first bucket, last bucket, uses): each source's stretch of the pattern's ring
    for p, got, n in zip(patterns, flow, supply, strict=True):
        start = 0.0
        for s, f in sorted(got.items()):
            stop, at = start + f, 0
            for b in sorted(hist[p]):
                mid = at + hist[p][b] / 2
                uses = math.ceil((stop - mid) / n) - math.ceil((start - mid) / n)
                at += hist[p][b]
                if rows and rows[-1][:2] == (p, names[s]) and rows[-1][4] == uses:
                    rows[-1] = (*rows[-1][:3], b, uses)
                else:
                    rows.append((p, names[s], b, b, uses))
            start = stop
    fields = [("pattern", T.StringType()), ("source", T.StringType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("uses", T.IntegerType())]
    plan = docs.sparkSession.createDataFrame([r for r in rows if r[4] > 0], T.StructType([T.StructField(n, t) for n, t in fields]))
    held = records.select("pattern", "bucket", "tokens", F.explode("held").alias("h")).select("pattern", "bucket", "tokens", F.col("h.source").alias("source"), F.col("h.doc_id").alias("doc_id"))
    # uses change at most at the two ends of a stretch: a few short rows for each source of each pattern
    chosen = held.join(F.broadcast(plan), ["pattern", "source"]).where(F.col("bucket").between(F.col("first"), F.col("last")))
    return chosen.select("doc_id", "source", "tokens", "uses")


def share_report(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, records, tokens, actual_share) for every weighted source."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    out = weights.select("source", "target_share").join(got, "source", "left").join(F.broadcast(total), how="cross")  # one row
    return out.select(
        "source", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"),
    )


def servable(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, present) for every row of weights: whether its source has a text at all.

    Read from the documents: the mixture has no record of a source whose share is 0 or less than half a record.
    """
    held = docs.where("text <> ''").select("source").distinct().withColumn("present", F.lit(True))
    return weights.join(held, "source", "left").select("source", "target_share", F.coalesce("present", F.lit(False)).alias("present"))
