"""File sinks: template tables, Markdown repositories, audit logs."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_target(root: str, relative: str) -> str:
    """The target below the root; a path that leaves it, or a root that is /, is refused."""
    base = posixpath.normpath(root)
    target = posixpath.normpath(posixpath.join(base, relative))
    if base in ("/", ".", "") or not target.startswith(base + "/"):
        raise ValueError(f"refused path: {relative}")
    return target


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated rows with a header, quoted where needed."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)


def write_template(candidates: DataFrame, path: str) -> None:
    """The template as TSV with its two header rows, in id order, as one file part per partition of a global sort."""
    from ..operators.exports import TEMPLATE_HEADER, TEMPLATE_RULES, template_rows

    spark = candidates.sparkSession
    rules = spark.createDataFrame([(-1, *TEMPLATE_RULES)], ", ".join(["_n long", *(f"`{c}` string" for c in TEMPLATE_HEADER)]))
    rows = template_rows(candidates)
    ids = candidates.select(F.col("id").alias("_n"), F.col("candidate_id").alias("ID"))
    both = rules.unionByName(rows.join(ids, "ID").select("_n", *TEMPLATE_HEADER)).orderBy("_n").drop("_n").coalesce(1)  # a template is one file
    both.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_markdown(files: DataFrame, root: str) -> DataFrame:
    """One file per row (file, value) below ``root``, a folder that every executor has mounted (a network share); written atomically.

    Returns (file, bytes). Tasks write their own rows under names of their own attempt and move them into
    place, so retries and speculative copies never meet. On a cluster whose executors share no folder, write
    the rows as a table instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyspark import TaskContext

        own = f".{TaskContext.get().taskAttemptId()}.part"
        for b in batches:
            sizes = []
            for name, value in zip(b["file"], b["value"], strict=True):
                target = safe_target(root, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target + own, "w", encoding="utf-8") as f:
                    f.write(value)
                os.replace(target + own, target)
                sizes.append(len(value.encode()))
            yield pd.DataFrame({"file": b["file"], "bytes": sizes})

    return files.select("file", "value").mapInPandas(run, "file string, bytes long")


def append_audit(events: DataFrame, path: str) -> None:
    """JSON lines appended, secrets redacted."""
    from ..operators.exports import audit_events

    audit_events(events).write.mode("append").json(path)


def sidecar(papers: DataFrame, path: str) -> None:
    """One JSON object per paper."""
    papers.select(F.to_json(F.struct(*papers.columns)).alias("value")).write.mode("overwrite").text(path)
