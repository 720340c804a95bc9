"""Cleaning of page texts across the pages of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _kept(pages: DataFrame, most: int, edge: int) -> DataFrame:
    """Pages with the array of lines that stay."""
    ls = F.filter(F.transform(tx.lines("text"), tx.strip), lambda x: x != "")
    p = pages.where("text is not null").withColumn("_ls", ls)
    n = F.size("_ls")
    both = F.concat(F.slice("_ls", F.lit(1), F.lit(edge)), F.slice("_ls", F.greatest(n - edge + 1, F.lit(1)), F.lit(edge)))
    edges = F.array_distinct(F.transform(F.filter(both, lambda x: F.length(x) <= most), F.lower))
    counts = p.select("doc_id", "page_id", F.explode(edges).alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("on_pages"))
    size = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    half = F.greatest(F.lit(2), F.floor(F.col("pages") / 2))
    rep = counts.where("on_pages >= 2").join(size, "doc_id").where(F.col("on_pages") >= half).groupBy("doc_id").agg(F.collect_list("line").alias("rep"))
    keep = F.filter(tx.lines("text"), lambda x: ~tx.strip(x).rlike(r"(?i)^(?:page\s*)?\d+$") & ~F.coalesce(F.array_contains("rep", F.lower(tx.strip(x))), F.lit(False)))
    return p.drop("_ls").join(rep, "doc_id", "left").withColumn("keep", keep)


def strip_headers_footers(pages: DataFrame, most: int = 120, edge: int = 4) -> DataFrame:
    """(doc_id, page_id, page_number, text) without lines that repeat at page edges.

    A line counts once per page among the first and last non-blank lines; it repeats if it occurs on
    at least two pages and on at least half of the file's pages (rounded down). The decision is one
    aggregation by (file, line); it comes back to the pages as an array per file.
    """
    return _kept(pages, most, edge).select("doc_id", "page_id", "page_number", tx.whitespace_a(F.array_join("keep", "\n")).alias("text"))


def kept_lines(pages: DataFrame, most: int = 120, edge: int = 4) -> DataFrame:
    """(doc_id, page_id, kept_lines): non-blank lines that stay."""
    return _kept(pages, most, edge).select("doc_id", "page_id", F.size(F.filter("keep", lambda x: tx.strip(x) != "")).alias("kept_lines"))
