"""Nested papers of records and files, their validation, and listings built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segments as sg
from ..functions import text as tx


def attachment(prefix: str = "") -> Column:
    """type, name, path, kind of a file and whether its text was read."""
    c = lambda n: F.col(prefix + n)
    kind = F.coalesce(tx.empty_to_null(F.regexp_replace(c("suffix"), r"^\.+", "")), F.lit("file"))
    return F.struct(
        kind.alias("type"), c("filename").alias("filename"), c("path").alias("path"), tx.mime_type(prefix + "suffix").alias("mime_type"),
        (F.coalesce(c("content"), F.lit("")) != "").alias("text_extracted"),
    )


def candidate_payload(candidates: DataFrame) -> DataFrame:
    """Stored candidates as nested records; missing lists are empty."""
    none = F.array().cast("array<string>")
    return candidates.select(
        "candidate_id", "document_id", "label", tx.label_key("label").alias("normalized_label"), F.coalesce("synonyms", none).alias("synonyms"), "confidence_score", "review_status",
        F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"), F.get(F.col("evidence"), F.lit(0))["quoted_text"].alias("first_quote"),
    )


def full_texts(documents: DataFrame) -> DataFrame:
    """(source_id, full_text): normalised texts of a record's files in id order; a record's files are bounded by the record."""
    t = documents.where("source_id is not null").select("source_id", "id", tx.whitespace_b("content").alias("t")).where("t is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"])
    return t.groupBy("source_id").agg(F.array_join(parts, "\n\n").alias("full_text"))


def source_text_flags(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """F42, listing variant: (id, quality_flags); a text counts if it is more than white space. No text is shuffled."""
    d = documents.where("source_id is not null").groupBy("source_id").agg(
        F.max(tx.clean_string("content").isNotNull()).alias("has_text"), F.max((F.col("suffix") == ".pdf") & (F.coalesce("content", F.lit("")) == "")).alias("scanned")
    )
    s = sources.select("id", "title", "abstract").join(d, F.col("id") == F.col("source_id"), "left")
    checks = [
        ("missing_title", F.coalesce("title", F.lit("")) == ""), ("missing_attachment", F.col("source_id").isNull()),
        ("missing_full_text", ~F.coalesce("has_text", F.lit(False)) & (F.coalesce("abstract", F.lit("")) == "")), ("possible_scanned_pdf", F.coalesce("scanned", F.lit(False))),
    ]
    return s.select("id", F.array_sort(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())).alias("quality_flags"))


def source_papers(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """One nested paper per record, with its files, link, flags and text size; then one per unlinked file."""
    copies = sources.where("provider_item_key is not null").groupBy("provider_item_key").agg(F.count(F.lit(1)).alias("copies"))
    files = documents.where("source_id is not null").groupBy("source_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", attachment().alias("a")))), lambda x: x["a"]).alias("attachments"),
        F.min_by("path", "id").alias("first_path"), F.max(tx.whitespace_b("content").isNotNull()).alias("has_text"),
        F.max((F.col("suffix") == ".pdf") & (F.coalesce("content", F.lit("")) == "")).alias("scanned"), F.sum(F.coalesce(F.length(tx.whitespace_b("content")), F.lit(0))).alias("chars"),
    )
    s = sources.join(copies, "provider_item_key", "left").join(files, sources.id == files.source_id, "left")
    link = tx.select_uri("provider_item_key", F.col("copies"), F.lit(None).cast("long"))
    no_text, no_abstract = ~F.coalesce("has_text", F.lit(False)), F.coalesce("abstract", F.lit("")) == ""
    flags = _flags(F.coalesce("title", F.lit("")) == "", F.col("source_id").isNull(), no_text, no_abstract, F.coalesce("scanned", F.lit(False)))
    key_ok = tx.is_item_key("provider_item_key")
    none = F.array().cast("array<struct<type:string,filename:string,path:string,mime_type:string,text_extracted:boolean>>")
    one = s.select(
        F.lit("source").alias("kind"), F.col("id"), tx.paper_id("provider_item_key", "doi", F.coalesce("first_path", "title")).alias("paper_id"),
        F.when(key_ok, F.col("provider_item_key")).alias("item_key"), link["uri"].alias("uri"), link["problem"].alias("diagnostic"), "title", tx.creator_names("creators").alias("authors"),
        tx.year_any("year").alias("year"), "doi", F.coalesce("attachments", none).alias("attachments"), F.when(no_text, "missing_text").otherwise("success").alias("status"),
        F.coalesce("chars", F.lit(0)).alias("chars"), (~no_abstract).alias("has_abstract"), flags.alias("quality_flags"),
    )
    d = documents.where("source_id is null").withColumn("t", tx.whitespace_b("content"))
    no_text = F.col("t").isNull()
    two = d.select(
        F.lit("document").alias("kind"), F.col("id"), tx.paper_id(F.lit(None).cast("string"), F.lit(None).cast("string"), "path").alias("paper_id"), F.lit(None).cast("string").alias("item_key"),
        F.lit(None).cast("string").alias("uri"), F.lit("missing_key").alias("diagnostic"), F.col("filename").alias("title"), F.array().cast("array<string>").alias("authors"),
        F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("doi"), F.array(attachment()).alias("attachments"), F.when(no_text, "missing_text").otherwise("success").alias("status"),
        F.coalesce(F.length("t"), F.lit(0)).cast("long").alias("chars"), F.lit(False).alias("has_abstract"),
        _flags(F.coalesce("filename", F.lit("")) == "", F.lit(False), no_text, F.lit(True), (F.col("suffix") == ".pdf") & (F.coalesce("content", F.lit("")) == "")).alias("quality_flags"),
    )
    return one.unionByName(two)


def _flags(title: Column, files: Column, text: Column, abstract: Column, scanned: Column) -> Column:
    checks = [("missing_title", title), ("missing_attachment", files), ("missing_full_text", text), ("missing_text_content", text & abstract), ("possible_scanned_pdf", scanned)]
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks)), lambda x: x.isNotNull()))


def payload_violations(papers: DataFrame) -> DataFrame:
    """(kind, id, violation) of papers (as source_papers gives them) that break the payload's rules."""
    copies = papers.where("paper_id <> ''").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("paper_id", F.lit(True).alias("repeated"))
    p = papers.join(copies, "paper_id", "left")
    checks = [
        ("no_paper_id", F.coalesce("paper_id", F.lit("")) == ""), ("repeated_paper_id", F.col("repeated")), ("bad_item_key", F.col("item_key").isNotNull() & ~tx.is_item_key("item_key")),
        ("uri_without_key", F.col("uri").isNotNull() & F.col("item_key").isNotNull() & ~F.contains("uri", F.col("item_key"))),
        ("no_text_without_flag", (F.col("chars") == 0) & ~F.col("has_abstract") & ~F.array_contains("quality_flags", "missing_full_text")),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())
    return p.select("kind", "id", F.explode(found).alias("violation"))


def sentinel_documents(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """One text document per record that has none under its fixed path: title, names, abstract, DOI, address; empty parts are skipped."""
    names = F.array_join(F.filter(F.transform("creators", lambda x: F.concat_ws(" ", tx.empty_to_null(x["given"]), tx.empty_to_null(x["family"]))), lambda x: x.isNotNull()), "; ")
    body = F.concat_ws("\n\n", *(tx.empty_to_null(c) for c in (F.col("title"), names, F.col("abstract"), F.col("doi"), F.col("url"))))
    d = sources.select(F.concat(F.lit("__source__/"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("source-"), F.col("id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(".txt").alias("suffix"), F.octet_length(body).cast("long").alias("size_bytes"), F.col("id").alias("source_id"), body.alias("content"))
    return d.join(stored.select("path"), "path", "left_anti")


def entry_details(sources: DataFrame, matched: DataFrame, papers: DataFrame, sections: DataFrame) -> DataFrame:
    """Listed entries with the paper's own values before the record's.

    matched: entry_id, file (as linking.entries gives them); papers: file, title, year, doi, abstract;
    sections: file (a row per section).
    """
    n = sections.groupBy("file").agg(F.count(F.lit(1)).alias("sections"))
    p = papers.select("file", *(tx.empty_to_null(F.col(c).cast("string")).alias("p_" + c) for c in ("title", "year", "doi", "abstract"))).join(n, "file", "left")
    s = sources.select(F.concat(F.lit("source-"), F.col("id").cast("string")).alias("entry_id"), *(tx.empty_to_null(F.col(c).cast("string")).alias("s_" + c) for c in ("title", "year", "doi", "abstract")), "item_type")
    e = matched.select("entry_id", "file").join(s, "entry_id", "left").join(p, "file", "left")
    own = [F.coalesce(f"p_{c}", f"s_{c}").alias(c) for c in ("title", "year", "doi", "abstract")]
    is_md = F.col("entry_id").startswith("markdown-")
    return e.select("entry_id", *own, F.when(is_md, "markdown").otherwise(F.col("item_type")).alias("item_type"), F.when(F.col("file").isNotNull(), "markdown_repository").otherwise("database_metadata").alias("content_source"), F.coalesce("sections", F.lit(0)).alias("sections"))


def synthetic_id(doi: Column, title: Column, citation: Column, most: int = 80) -> Column:
    """Slug of the first filled value."""
    seed = F.coalesce(tx.empty_to_null(doi), tx.empty_to_null(title), tx.empty_to_null(citation), F.lit("literature"))
    x = F.lower(F.regexp_replace(F.regexp_replace(seed, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(tx.empty_to_null(F.substring(x, 1, most)), F.lit("literature"))


def readable_sections(sections: DataFrame) -> DataFrame:
    """Sections without abstracts and without anything at or below a reference heading; reference tails are cut off.

    sections: heading, heading_path, text.
    """
    from ..functions.sections import REFERENCE

    refs = F.exists("heading_path", lambda h: tx.heading_key(h).isin(*REFERENCE))
    keep = ~refs & ~((F.size("heading_path") == 1) & (tx.heading_key("heading") == "abstract"))
    return sections.where(F.coalesce(keep, F.lit(False))).withColumn("text", tx.strip_references(F.coalesce("text", F.lit(""))))


def first_abstract(sections: DataFrame, key: str, order: str) -> DataFrame:
    """(key, abstract): the text of the first section called abstract."""
    return sections.where(tx.heading_key("heading") == "abstract").groupBy(key).agg(F.min_by("text", order).alias("abstract"))


def layers(sections: DataFrame, chunks: DataFrame | None = None, claims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and claims of a paper, computed only where they are not given."""
    return (sg.retrieval_chunks(sections) if chunks is None else chunks, sg.claims(sections) if claims is None else claims)


def labelled_documents(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """J-13: (id, filename, source_label): citation key, else item key, else id of the record."""
    filled = lambda c: tx.empty_to_null(F.col(c))
    s = sources.select(F.col("id").alias("source_id"), F.coalesce(filled("citation_key"), filled("provider_item_key"), F.col("id").cast("string")).alias("source_label"))
    return documents.select("id", "filename", "source_id").join(s, "source_id", "left").select("id", "filename", "source_label")


def under(path: Column, root: str) -> Column:
    """Is the path inside the folder?"""
    return path.startswith(root.rstrip("/") + "/")


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing columns added with their defaults; existing ones stay."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def settings(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, value): the stored value, else the default; keys of either side."""
    j = defaults.select("key", F.col("value").alias("d")).join(stored.select("key", F.col("value").alias("v")), "key", "full")
    return j.select("key", F.coalesce("v", "d").alias("value"))


def put_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored settings after changes; NULL changes are ignored, the last of several (by ord) wins."""
    new = changes.where("value is not null").groupBy("key").agg(F.max_by("value", "ord").alias("v"))
    return stored.join(new, "key", "full").select("key", F.coalesce("v", "value").alias("value"))
