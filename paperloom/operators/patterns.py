"""Which of many strings occur inside texts: one automaton per pass over the texts, no text in a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one automaton holds (some 100 bytes each in a worker).
MAX_CHARS = 4_000_000


class Finder:
    """All patterns that occur in a text, with the values they stand for."""

    def __init__(self, patterns: list[tuple]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, *value in patterns:
            self.automaton.add_word(p, (p, *value))
        self.ready = bool(patterns)
        if self.ready:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> Iterator[tuple]:
        return (v for _, v in self.automaton.iter(text)) if self.ready and text else iter(())


def shards(patterns: DataFrame, column: str, most: int = MAX_CHARS) -> Iterator[list[tuple]]:
    """The rows of ``patterns`` in lists of about ``most`` characters of ``column``, which is distinct and not empty."""
    total = patterns.agg(F.sum(F.length(column))).first()[0] or 0
    n = max(1, math.ceil(total / most))
    rest = [c for c in patterns.columns if c != column]
    for k in range(n):
        mine = patterns if n == 1 else patterns.where(F.pmod(F.xxhash64(column), F.lit(n)) == k)
        yield [tuple(r) for r in mine.select(column, *rest).collect()]  # about ``most`` characters


def occurrences(texts: DataFrame, key: str, text: str, patterns: DataFrame, column: str, most: int = MAX_CHARS) -> DataFrame:
    """(key, column): each pattern that occurs in a text, once. Every shard of patterns is one map over the texts."""
    kind = texts.schema[key].dataType.simpleString()

    def finder(shard: list[tuple]) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = Finder(shard)
            for b in batches:
                rows = [(k, p) for k, x in zip(b[key], b[text], strict=True) for p in {v[0] for v in find(x)}]
                yield pd.DataFrame(rows, columns=[key, column])

        return run

    found = None
    for shard in shards(patterns.select(column), column, most):
        part = texts.select(key, text).mapInPandas(finder(shard), f"{key} {kind}, {column} string")
        found = part if found is None else found.unionByName(part)
    return found
