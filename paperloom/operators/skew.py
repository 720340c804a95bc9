"""Joins and group heads that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many of the largest keys are joined by broadcast. A key outside them holds at most
#: 1/HOT_KEYS of the rows, so no shuffle partition is dominated by one key.
HOT_KEYS = 1000


def join_on_unique(left: DataFrame, right: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner equi-join of ``left`` with ``right``, whose ``key`` is unique and never null.

    ``weight`` (a column of right) is the number of left rows of the key. The ``hot_keys``
    heaviest keys are a top-k of fixed size and broadcast; all others go through a shuffle.
    Both branches together return each match exactly once; null keys match nothing.
    """
    hot = right.orderBy(F.desc(weight), F.asc(key)).limit(hot_keys)
    hot_left = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        right.join(F.broadcast(hot.select(key)), key, "left_anti"), key
    )
    return hot_left.unionByName(rest)


def group_heads(df: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, head_id, copies) of every key with more than one row; partial aggregation first."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(ident).alias("head_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def with_group_head(df: DataFrame, key: str, ident: str, salts: int = 64) -> DataFrame:
    """The rows whose key occurs more than once, with ``head_id`` (smallest ident) and ``copies``.

    Rows are counted by (key, salt) first; a key's at most ``salts`` partial counts are then summed
    and joined back by (key, salt). A key with a third of all rows is so spread over ``salts``
    shuffle groups, and no other row is replicated. Null keys are dropped.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("byte"))
    part = rows.groupBy(key, "_salt").agg(F.min(ident).alias("_head"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    heads = part.select(key, "_salt", F.min("_head").over(w).alias("head_id"), F.sum("_n").over(w).alias("copies")).where("copies > 1")
    return rows.join(heads, [key, "_salt"]).drop("_salt")


def salted(key: Column, row: Column, salts: int) -> list[Column]:
    """Grouping columns (key, salt) of a first aggregation step; group by key alone in the second."""
    return [key.alias("key"), F.pmod(F.xxhash64(row), F.lit(salts)).alias("salt")]


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with positions from 1 by ``order`` (unique): counted within sorted ranges, offset by the ranges before."""
    from itertools import accumulate

    from pyspark.sql import Window

    from ..session import cut_lineage

    rows = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range
    offsets = dict(zip([k for k, _ in counts], accumulate([0, *(n for _, n in counts)]), strict=False))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    if not offsets:
        return rows.drop("_part").withColumn(name, F.lit(0).cast("long"))
    start = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    return rows.withColumn(name, (at + start[F.col("_part")]).cast("long")).drop("_part")
