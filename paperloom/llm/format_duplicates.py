"""Duplicates hidden by formatting differences, by progressive partition refinement.

Records are first partitioned by cheap invariants that every pair of agreeing records shares
(field presence, stripped lengths, a letter histogram). Only classes with several members are
refined by the costlier exact key (full stripped text, parsed JSON). Singletons leave early, so
long keys are shuffled, and JSON is parsed in Python, only for rows that may have a partner.

Results for odd input: a value without letters or digits counts as empty; a missing DOI agrees
only with a missing one; NULL titles and titles without letters agree with each other, but a
record with neither title nor DOI content agrees with none; labels without letters or digits and
rows without a ``document_id`` are no cases; raw records that are no JSON object agree only with
an unchanged copy; NULL raw records agree with none; rows with NULL ids keep their group but are
not reported; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import with_group_head
from ..session import cut_lineage

#: A leading resolver address and/or a leading ``doi`` label.
DOI_LEAD = r"^\s*(?:(?:https?:)?//)?(?:[a-z0-9-]+\.)*doi\.[a-z]+/+|^\s*https?://[^/\s]+/+"
DOI_LABEL = r"^[^a-z0-9]*(?:doi\b[^a-z0-9]*)?"
NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: Bins of the letter histogram: counts of these characters are kept, all others share the length.
HISTOGRAM_BINS = ("E", "AO", "IN", "TS", "RL", "CDU", "0123456789")


def stripped(c: Column) -> Column:
    """Letters and digits in order, without case; '' for NULL."""
    return F.coalesce(F.regexp_replace(F.upper(c), NOT_ALNUM, F.lit("")), F.lit(""))


def stripped_doi(c: Column) -> Column:
    """As stripped, after removal of a leading resolver address and ``doi`` label."""
    low = F.regexp_replace(F.lower(c), DOI_LEAD, "")
    return stripped(F.regexp_replace(low, DOI_LABEL, ""))


def histogram(c: Column) -> list[Column]:
    """Occurrences of each bin's characters: equal for any order of the same characters."""
    return [F.length(c) - F.length(F.translate(c, b, "")) for b in HISTOGRAM_BINS]


def refine(staged: DataFrame) -> DataFrame:
    """(item_table, id, head_id, copies) of every row of a group of several.

    ``staged``: item_table, id, invariant, exact (text of the exact key or NULL), raw. First by the
    invariant; of the survivors only ids and digests of the exact key are kept, then grouped by it.
    """
    survivors = with_group_head(staged, "invariant", "id").select(
        "item_table", "id", F.coalesce(F.md5(F.to_binary("exact", F.lit("utf-8"))), record_key("raw")).alias("group_key")
    )
    return with_group_head(cut_lineage(survivors), "group_key", "id").select("item_table", "id", "head_id", "copies")


def _staged(name: str, df: DataFrame, ident: str, invariants: list[Column], exact: Column, raw: Column) -> DataFrame:
    tag = F.lit(name)
    return df.select(tag.alias("item_table"), F.col(ident).alias("id"), F.xxhash64(tag, *invariants).alias("invariant"), exact.alias("exact"), raw.alias("raw"))


def staged_sources(sources: DataFrame) -> DataFrame:
    d = sources.select("id", stripped(F.col("title")).alias("t"), stripped_doi(F.col("doi")).alias("d")).where("t <> '' or d <> ''")
    exact = F.concat_ws("\u0001", F.lit("s"), "t", "d")
    return _staged("literature_sources", d, "id", [F.length("t"), F.length("d"), *histogram(F.col("t"))], exact, F.lit(None).cast("string"))


def staged_terms(terms: DataFrame) -> DataFrame:
    d = terms.select("id", "document_id", stripped(F.col("label")).alias("t")).where("t <> '' and document_id is not null")
    exact = F.concat_ws("\u0001", F.lit("t"), F.col("document_id").cast("string"), "t")
    return _staged("candidate_terms", d, "id", [F.col("document_id"), F.length("t"), *histogram(F.col("t"))], exact, F.lit(None).cast("string"))


def staged_records(items: DataFrame) -> DataFrame:
    title = stripped(F.get_json_object("raw", "$.title"))
    d = items.where("raw is not null").select("raw_id", "raw", title.alias("t"), F.array_sort(F.json_object_keys("raw")).alias("names"))
    return _staged("csl_items", d, "raw_id", [F.col("names"), F.length("t"), *histogram(F.col("t"))], F.lit(None).cast("string"), F.col("raw"))


_strip_re = re.compile(r"[\W_]+")
_lead_re = re.compile(DOI_LEAD)
_label_re = re.compile(DOI_LABEL)


def _canon(v, name: str = ""):
    if isinstance(v, dict):
        return {k: _canon(v[k], k) for k in v}
    if isinstance(v, list):
        return [_canon(x, name) for x in v]
    if v is None or isinstance(v, bool):
        return {"": json.dumps(v)}
    s = str(v)
    if name == "DOI":
        s = _label_re.sub("", _lead_re.sub("", s.lower()))
    return _strip_re.sub("", s.upper())


def canonical_record(raw: str) -> str:
    """Field order and value formatting removed; not an object: the raw text behind a mark."""
    try:
        v = json.loads(raw, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        v = None
    if not isinstance(v, dict):
        return "\u0000" + raw
    return json.dumps(_canon(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def record_key(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else hashlib.md5(canonical_record(x).encode("utf-8", "surrogatepass")).hexdigest())


def format_duplicates(*staged: DataFrame) -> DataFrame:
    """(item_table, id, head_id, copies) of every record that shares its content with another.

    All tables are refined together: one pass of each level, whatever the number of tables.
    """
    return refine(reduce(DataFrame.unionByName, staged))


def copies_found(groups: DataFrame) -> DataFrame:
    """One row for each record beyond the first of its group."""
    return groups.where("id > head_id").select("item_table", F.col("head_id").alias("first_id"), F.col("id").alias("copy_id"))


def collapsed(groups: DataFrame) -> DataFrame:
    """One row for each group: the kept record and its number of copies."""
    return groups.where("id = head_id").select("item_table", F.col("head_id").alias("kept_id"), "copies").distinct()
