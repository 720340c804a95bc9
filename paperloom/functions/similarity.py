"""Similarity scores that follow the standard library's sequence matcher, as Arrow batches.

The matcher is asymmetric, so the argument order is kept: new value first, existing value second.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores and thresholds of the matching rules.
CONTAINED, LEAST_SCORE, EXACT_FROM, MAP_EXISTING, FUZZY_TITLE = 0.85, 0.35, 0.99, 0.82, 0.82
#: Names of a term list that one pass over the labels scores; longer lists take several passes.
MAX_NAMES = 20_000


def fold(s: str | None) -> str:
    return " ".join((s or "").casefold().split())


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def one_score(a: str, b: str) -> float:
    """R01 of two folded strings: 1 for equal, at least 0.85 for contained, else the rounded ratio."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(CONTAINED if a in b or b in a else 0.0, round(ratio(a, b), 3))


def local_score(label: str, names: list[str]) -> float:
    """The best over the names."""
    return max((one_score(fold(label), fold(n)) for n in names), default=0.0)


def local_scores(query: str):
    """R01 of one query against arrays of names, as a column function."""

    @F.pandas_udf(T.DoubleType())
    def score(names: pd.Series) -> pd.Series:
        return names.map(lambda ns: local_score(query, list(ns)))

    return score


def external_score(label: str, name: str) -> float:
    """1 for equal, exactly 0.85 for contained, else the rounded ratio."""
    a, b = fold(label), fold(name)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return CONTAINED if a in b or b in a else round(ratio(a, b), 3)


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unrounded ratio of two titles; NULL if either is NULL."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def external_confidence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([external_score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_words(a: Column, b: Column) -> Column:
    """Number of distinct shared words."""
    return F.size(F.array_intersect(a, b))


def _classes(names: list[str]) -> np.ndarray:
    """Names as rows of character classes, filled up with class 127; characters may share a class, which only raises a bound."""
    width = max(map(len, names), default=0)
    out = np.full((len(names), width), 127, dtype=np.uint8)
    for k, s in enumerate(names):
        out[k, : len(s)] = [ord(c) % 127 for c in s]
    return out


def common_subsequence(a: str, names: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each row of classes, by bit vectors over all rows at once.

    Matching blocks of the sequence matcher keep their order, so 2 * length / (both lengths) is never below the ratio.
    """
    words = -(-len(a) // 64) or 1
    masks = np.zeros((128, words), dtype=np.uint64)
    for i, c in enumerate(a):
        masks[ord(c) % 127, i // 64] |= np.uint64(1 << (i % 64))
    v = [np.full(len(names), np.uint64(2**64 - 1)) for _ in range(words)]
    for j in range(names.shape[1]):
        at = names[:, j]
        carry = np.zeros(len(names), dtype=np.uint64)
        for w in range(words):
            m = masks[at, w]
            old = v[w]
            total = old + (old & m)
            over = total < old
            again = total + carry
            carry = (over | (again < total)).astype(np.uint64)
            v[w] = again | (old & ~m)
    out = np.zeros(len(names), dtype=np.int64)
    for w in range(words):
        bits = min(64, len(a) - 64 * w)
        used = np.uint64(2**bits - 1 if bits > 0 else 0)
        out += np.bitwise_count(~v[w] & used).astype(np.int64)
    return out


class TermMatcher:
    """Top terms for a label; exact scores only where the bound can still enter the result."""

    def __init__(self, terms: list[tuple[str, list[str]]]) -> None:
        self.terms = terms
        names = [(k, fold(n)) for k, (_, ns) in enumerate(terms) for n in ns if n and fold(n)]
        self.owner = np.array([k for k, _ in names], dtype=np.int64)
        self.names = [n for _, n in names]
        self.classes = _classes(self.names)
        self.size = np.array([len(n) for n in self.names], dtype=np.int64)

    def top(self, labels: list[str], most: int = 5) -> list[tuple[int, float]]:
        """(term position, score) with score above 0.35, best first, ties in list order."""
        scores = np.zeros(len(self.terms))
        for label in labels:
            a = fold(label)
            if not a or not self.names:
                continue
            bound = 2.0 * common_subsequence(a, self.classes) / (len(a) + self.size)
            for k in np.argsort(-bound, kind="stable"):
                term = self.owner[k]
                b = self.names[k]
                floor = LEAST_SCORE
                if len(self.terms) > most:
                    floor = max(floor, np.partition(scores, -most)[-most] - 0.001)
                if bound[k] < floor:
                    break
                s = one_score(a, b)
                scores[term] = max(scores[term], s)
            for k in [k for k, b in enumerate(self.names) if a in b or b in a]:  # contained names may have a low bound
                scores[self.owner[k]] = max(scores[self.owner[k]], 1.0 if a == self.names[k] else CONTAINED)
        order = np.argsort(-scores, kind="stable")[:most]
        return [(int(k), float(scores[k])) for k in order if scores[k] > LEAST_SCORE]


def match_terms(labels: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """J-08/R03: (label, synonyms, rank, term_id, score, match_type) of the distinct candidates, by the best of label and synonyms.

    ``terms`` (ord, term_id, label, synonyms) is sent out in parts of about MAX_NAMES names, one pass over
    the candidates each, whose top lists are merged; ties keep the list order.
    """
    total = terms.agg(F.sum(F.lit(1) + F.coalesce(F.size("synonyms"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-total // MAX_NAMES))
    spark = labels.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # scoring is the cost, not the rows: the distinct candidates must not be coalesced into few tasks
    distinct = labels.select("label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms")).where("label is not null").distinct().repartition(tasks)

    def matcher(plain: list[tuple]):
        def run(batches):
            m = TermMatcher([(t, names) for _, t, names in plain])
            for b in batches:
                rows = [(x, list(ys), plain[t][0], plain[t][1], s) for x, ys in zip(b["label"], b["synonyms"], strict=True) for t, s in m.top([x, *ys], most)]
                yield pd.DataFrame(rows, columns=["label", "synonyms", "ord", "term_id", "score"])

        return run

    found = None
    for k in range(parts):
        mine = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("ord"), F.lit(parts)) == k)
        plain = sorted((r.ord, r.term_id, [r.label, *(r.synonyms or [])]) for r in mine.select("ord", "term_id", "label", "synonyms").collect())  # about MAX_NAMES names
        part = distinct.mapInPandas(matcher(plain), "label string, synonyms array<string>, ord long, term_id string, score double")
        found = part if found is None else found.unionByName(part)
    r = F.row_number().over(Window.partitionBy("label", "synonyms").orderBy(F.desc("score"), "ord"))
    kind = F.when(F.col("score") >= EXACT_FROM, "exact_or_synonym").otherwise("label_similarity")
    return found.withColumn("rank", r).where(F.col("rank") <= most).select("label", "synonyms", "rank", "term_id", "score", kind.alias("match_type"))


#: Titles that one pass of best_ratios compares with.
RATIO_BLOCK = 50_000


def best_ratios(titles: DataFrame, generated: DataFrame, least: float) -> DataFrame:
    """(key, ord, score): for each distinct title the generated one of the best ratio of at least ``least``, the first of equal ones.

    titles: key; generated: key, ord. The titles are a query set, the generated ones go out in blocks sorted
    by length: lengths, then common subsequences bound the ratio from above, and only what can still win is compared.
    """
    n = generated.count()
    parts = max(1, -(-n // RATIO_BLOCK))

    def compare(block: list[tuple]):
        def run(batches):
            names = [k for k, _ in block]
            classes, size = _classes(names), np.array([len(k) for k in names])
            for b in batches:
                rows = []
                for a in b["key"]:
                    lo = np.searchsorted(size, len(a) * least / (2 - least) - 1)
                    hi = np.searchsorted(size, len(a) * (2 - least) / least + 1)
                    bound = 2.0 * common_subsequence(a, classes[lo:hi]) / np.maximum(len(a) + size[lo:hi], 1)
                    best = (least, None)
                    for k in np.argsort(-bound, kind="stable"):
                        if bound[k] < best[0]:
                            break
                        r = ratio(a, names[lo + k])
                        if r > best[0] or (r == best[0] and (best[1] is None or block[lo + k][1] < best[1])):
                            best = (r, block[lo + k][1])
                    if best[1] is not None:
                        rows.append((a, best[1], best[0]))
                yield pd.DataFrame(rows, columns=["key", "ord", "score"])

        return run

    tasks = max(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), titles.sparkSession.sparkContext.defaultParallelism)
    queries = titles.select("key").repartition(tasks)  # comparing is the cost, not the rows
    found = None
    for k in range(parts):
        mine = generated if parts == 1 else generated.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        block = sorted((tuple(r) for r in mine.select("key", "ord").collect()), key=lambda r: (len(r[0]), r[0]))  # about RATIO_BLOCK titles
        part = queries.mapInPandas(compare(block), "key string, ord long, score double")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("key").agg(F.max(F.struct("score", (-F.col("ord")).alias("m"))).alias("b"))
    return best.select("key", (-F.col("b.m")).alias("ord"), "b.score")
