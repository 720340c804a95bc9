"""The pN_ queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import containers as ct
from . import cross_match as cm
from . import format_duplicates as fd
from . import lookalikes as la
from . import mixture as mx
from . import page_noise as pg
from . import pieces as pc
from . import term_mapping as tm
from . import truncation as tr


def _p1(s: SparkSession, d: str) -> DataFrame:
    return fd.format_duplicates(
        fd.staged_sources(table(s, d, "literature_sources")), fd.staged_terms(table(s, d, "candidate_terms")), fd.staged_records(table(s, d, "csl_items"))
    )


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return fd.copies_found(_p1(s, d))


def p1_collapsed(s: SparkSession, d: str) -> DataFrame:
    return fd.collapsed(_p1(s, d))


def p1_terms(s: SparkSession, d: str) -> DataFrame:
    return fd.format_duplicates(fd.staged_terms(table(s, d, "candidate_terms"))).where("id = head_id").select("id", "copies")


def _p2(s: SparkSession, d: str) -> DataFrame:
    sections = table(s, d, "sections_flat").select(F.lit("sections_flat").alias("item_table"), F.col("section_id").alias("item_id"), "text")
    files = table(s, d, "literature_documents").select(F.lit("literature_documents").alias("item_table"), F.col("id").alias("item_id"), F.col("content").alias("text"))
    limits = table(s, d, "size_limits").where("unit = 'characters'").select("item_table", "max_size", "overlap")
    return pc.split_oversized(sections.unionByName(files), limits)


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return pc.oversized_found(_p2(s, d))


def p2_pieces(s: SparkSession, d: str) -> DataFrame:
    return _p2(s, d)


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return p3_matches(s, d).select("source_id", "document_id")


def p3_matches(s: SparkSession, d: str) -> DataFrame:
    return cm.match(table(s, d, "literature_sources"), table(s, d, "literature_documents"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return tm.mapped_rows(table(s, d, "candidate_terms"), table(s, d, "ontology_terms"))


def p4_labels(s: SparkSession, d: str) -> DataFrame:
    return tm.map_rows(table(s, d, "candidate_terms"), table(s, d, "ontology_terms"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return tr.truncated(table(s, d, "paper_metadata")).select("meta_id", "field")


def p5_rates(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "paper_metadata")
    return tr.rates(rows, tr.truncated(rows))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return pg.noise_found(pg.items(table(s, d, "extracted_pages"), table(s, d, "sections_flat")))


def p6_repaired(s: SparkSession, d: str) -> DataFrame:
    return pg.repaired(pg.items(table(s, d, "extracted_pages"), table(s, d, "sections_flat")))


def _capacity(s: SparkSession, d: str) -> int:
    return table(s, d, "size_limits").where("item_table = 'documents' and unit = 'tokens'").first().max_size


def p7_containers(s: SparkSession, d: str) -> DataFrame:
    return ct.fill_containers(table(s, d, "documents"), _capacity(s, d))


def p7_fill(s: SparkSession, d: str) -> DataFrame:
    return ct.fill_report(p7_containers(s, d), _capacity(s, d))


def p5_values(s: SparkSession, d: str) -> DataFrame:
    """Values per intake and field that the rates refer to."""
    rows = table(s, d, "paper_metadata")
    return tr.rates(rows, tr.truncated(rows)).select("intake", "field", F.col("values").alias("n"))


def p7_totals(s: SparkSession, d: str) -> DataFrame:
    """Every text is packed once and whole, and no container is overfull."""
    packed = p7_containers(s, d)
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    most = used.agg((F.max("used") <= _capacity(s, d)).alias("fits"))
    parts = packed.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("chars"))
    return parts.agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars")).join(most, how="cross")  # one row each


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return mx.mix(table(s, d, "documents"), table(s, d, "source_weights"))


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return mx.share_report(p8_mixture(s, d), table(s, d, "source_weights"))


def p8_targets(s: SparkSession, d: str) -> DataFrame:
    """Which of the targets the mixture could serve; after the mixture, as the first query of an operator stands for it."""
    return mx.servable(table(s, d, "documents"), table(s, d, "source_weights"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return la.alike_pairs(table(s, d, "documents"))


def p9_classes(s: SparkSession, d: str) -> DataFrame:
    return la.alike_classes(table(s, d, "documents"))


def p9_forms(s: SparkSession, d: str) -> DataFrame:
    return la.consistent_form(table(s, d, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": r"""
            WITH k AS (SELECT id, document_id, regexp_replace(upper(label), '[^\p{L}\p{N}]+', '', 'g') AS t FROM candidate_terms)
            SELECT min(id) AS id, count(*) AS copies FROM k WHERE t <> '' AND document_id IS NOT NULL
            GROUP BY document_id, t HAVING count(*) > 1""",
        "p5_values": """
            SELECT intake, field, count(*) AS n FROM (SELECT intake, 'title' AS field, title AS v FROM paper_metadata UNION ALL SELECT intake, 'pdf_filename', pdf_filename FROM paper_metadata) WHERE trim(v) <> '' GROUP BY 1, 2""",
        "p7_totals": """SELECT count(*) AS texts, sum(n_chars) AS chars, true AS fits FROM documents WHERE text IS NOT NULL""",
        "p8_targets": """
            SELECT w.source, w.target_share, EXISTS (SELECT 1 FROM documents d WHERE d.source = w.source AND d.text <> '') AS present FROM source_weights w""",
        "p2_found": """
            SELECT 'sections_flat' AS item_table, section_id AS item_id FROM sections_flat
            WHERE length(text) > (SELECT max_size FROM size_limits WHERE item_table = 'sections_flat')
            UNION ALL SELECT 'literature_documents', id FROM literature_documents
            WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_table = 'literature_documents')""",
    }
