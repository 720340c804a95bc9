"""Export rows and rendered documents; writers live in paperloom.sources.writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .papers import with_columns


#: Header rows of the vocabulary template.
TEMPLATE_HEADER = ("ID", "LABEL", "TYPE", "definition", "parent", "synonyms", "xref", "notes", "curator_decision", "selected_ols_match", "selected_local_match", "source_document_id", "evidence")
TEMPLATE_RULES = ("ID", "A rdfs:label", "TYPE", "A IAO:0000115", "SC %", "A oboInOwl:hasExactSynonym", "A oboInOwl:hasDbXref", "A rdfs:comment", "", "", "", "", "")

_TEXT = ("proposed_definition", "proposed_parent", "curator_rationale", "curator_decision", "source_evidence", "selected_ols", "selected_local")


def _complete(candidates: DataFrame) -> DataFrame:
    """Columns that a stored table may lack; selections are JSON text of the chosen match."""
    df = with_columns(candidates, {c: F.lit(None).cast("string") for c in _TEXT})
    return with_columns(df, {"mappings": F.array().cast("array<string>")})


def _said(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _chosen(name: str, *keys: str) -> Column:
    """The first filled field of a selected match, '' if nothing is selected."""
    return F.coalesce(*(tx.empty_to_null(F.get_json_object(name, "$." + k)) for k in keys), F.lit(""))


def _quote() -> Column:
    return F.coalesce(tx.empty_to_null("source_evidence"), F.get("evidence", F.lit(0))["quoted_text"], F.lit(""))


def _joined(name: str) -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), "; ")


def template_rows(candidates: DataFrame) -> DataFrame:
    """Rows of the vocabulary template; several values joined by '; ', cross references with the selected external term."""
    xref = F.concat_ws("; ", tx.empty_to_null(_joined("mappings")), tx.empty_to_null(_chosen("selected_ols", "term_id", "iri")))
    return _complete(candidates).select(
        F.col("candidate_id").alias("ID"), F.col("label").alias("LABEL"), F.lit("owl:Class").alias("TYPE"), _said("proposed_definition").alias("definition"), _said("proposed_parent").alias("parent"),
        _joined("synonyms").alias("synonyms"), xref.alias("xref"), _said("curator_rationale").alias("notes"), _said("curator_decision").alias("curator_decision"),
        _chosen("selected_ols", "iri").alias("selected_ols_match"), _chosen("selected_local", "iri").alias("selected_local_match"),
        F.coalesce(F.col("document_id").cast("string"), F.lit("")).alias("source_document_id"), _quote().alias("evidence"),
    )


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Rows of the candidate table; confidence with three decimals."""
    return _complete(candidates).select(
        "candidate_id", "label", _said("proposed_definition").alias("definition"), F.col("review_status").alias("status"), F.format_string("%.3f", F.col("confidence_score")).alias("confidence"),
        _said("proposed_parent").alias("parent"), _chosen("selected_ols", "label").alias("selected_ols_label"), _chosen("selected_ols", "ontology_id").alias("selected_ols_ontology"),
        _chosen("selected_ols", "iri").alias("selected_ols_iri"), _chosen("selected_local", "label").alias("selected_local_label"), _chosen("selected_local", "iri").alias("selected_local_iri"),
        _said("curator_decision").alias("curator_decision"), F.col("document_id").alias("source_document_id"), _quote().alias("evidence"), _said("curator_rationale").alias("rationale"),
    )


def export(candidates: DataFrame, statuses: list[str], form: str) -> DataFrame:
    """Rows of the candidates in one of the given states, by id, as template or candidate table."""
    chosen = candidates.where(F.col("review_status").isin(*statuses)).orderBy("id")
    return template_rows(chosen) if form == "template" else candidate_rows(chosen)


def yaml_value(c: Column) -> Column:
    """Quoted with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _blocks(*parts: Column | str) -> Column:
    """Lines and blocks parted by single line ends; NULL parts are left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _field(name: str) -> Column:
    return F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), yaml_value(F.col(name).cast("string"))))


def paper_markdown(papers: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(file, value): front matter without empty fields, title, abstract, notes, sections; sections without text are left out.

    papers: title, abstract, sections array<struct<heading,text>>, and of id, authors (array), year, doi,
    pmid, source, url, imported_at, notes what there is. A number as year stands without quotes.
    """
    have = set(papers.columns)
    listed = F.when(F.size("authors") > 0, F.concat(F.lit("authors:"), F.array_join(F.transform("authors", lambda a: F.concat(F.lit("\n  - "), yaml_value(a))), ""))) if "authors" in have else None
    numeric = "year" in have and papers.schema["year"].dataType.typeName() in ("integer", "long")
    year = F.concat(F.lit("year: "), F.col("year").cast("string")) if numeric else None
    order = ("id", "title", "authors", "year", "doi", "pmid", "source", "url", "imported_at")
    fields = [listed if n == "authors" else year if n == "year" and numeric else _field(n) for n in order if n in have]
    notes = F.coalesce("notes", F.lit("")) if "notes" in have else F.lit("")
    filled = F.filter(F.coalesce("sections", F.array().cast("array<struct<heading:string,text:string>>")), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    parts = F.array_join(F.transform(filled, lambda s: F.concat(F.lit("### "), F.coalesce(tx.empty_to_null(s["heading"]), F.lit("Section")), F.lit("\n\n"), s["text"], F.lit("\n"))), "\n")
    title = F.coalesce(tx.empty_to_null("title"), F.lit("Untitled literature record"))
    body = _blocks(
        "---", F.concat_ws("\n", *fields), "---", "", F.concat(F.lit("# "), title), "", "## Abstract", "", F.coalesce("abstract", F.lit("")), "", "## Notes", "", notes, "",
        "## Extracted ontology-relevant information", "", parts,
    )
    seed = F.col("id").cast("string") if "id" in have else F.lit(None).cast("string")
    doi = F.col("doi") if "doi" in have else F.lit(None).cast("string")
    return papers.select(*(keep or []), tx.paper_filename(doi, seed, "title").alias("file"), F.concat(tx.strip(body), F.lit("\n")).alias("value"))


#: What the rendered files say about themselves.
FROM_LIBRARY = "This Markdown file was generated from a Zotero-managed local PDF. Images are omitted. Figure captions, table text, equations, references, and article body text are retained where the PDF text layer exposed them. The layout was converted into a single reading order for LLM/RAG ingestion."
FROM_FILE = "This Markdown file was generated from a local PDF file. Images were omitted. Extracted figure captions, table text, equations, references, and article body text are retained where the PDF text layer exposed them. The layout was converted into a single reading order for LLM/RAG ingestion."
FROM_LINES = "This Markdown file was generated from a PDF. Images were omitted. Extracted figure captions, table text, equations, references, and article body text are retained where the PDF text layer exposed them. The layout was converted into a single reading order for LLM/RAG ingestion."
FULL_TEXT = "## LLM-ready full-text Markdown"
CONCEPTS = ("Domain", "Study type", "Main system", "Main process", "Main methods", "Main measurements", "Main outputs", "Key variables", "Key models", "Main contribution", "Limitations")
CONCEPT_VALUES = {"Study type": "other"}
LLM_NOTES = (
    "This file contains extracted PDF text.", "Images are omitted.", "Figure captions are included only if they were present in the PDF text layer.",
    "Table text is included only if it was exposed by the PDF text layer.", "Equations are retained where exposed by the PDF text layer.", "No missing text was invented.",
    "Retrieval chunks are provided for RAG indexing.",
)


def _listed(mark: str, values: list[tuple[str, Column]]) -> Column:
    """Lines '* **Name:** value'."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{mark} **{n}:** "), F.coalesce(v.cast("string"), F.lit(""))) for n, v in values))


def _each(c: Column, render) -> Column:
    return F.array_join(F.transform(c, render), "\n")


def full_paper_markdown(papers: DataFrame, keep: list[str]) -> DataFrame:
    """Metadata, diagnostics, abstract, keywords, body, chunks and claims of one paper per row.

    papers: the metadata columns of the library, extraction_status, pdf_pages, extracted_characters, method,
    layout, references_extracted, warnings array, sections array<struct<heading,level,text>> in reading
    order, chunks array<struct<chunk_id,heading_path,pages,approx_tokens,chunk_type,key_terms,text>>,
    claims array<struct<claim_id,claim,section,pages,type>>.
    """
    col = F.col
    meta = [
        ("Title", col("title")), ("DOI", col("doi")), ("Citation", col("citation")), ("Authors", F.array_join("authors", "; ")), ("Year", col("year")), ("Journal", col("journal")), ("Volume", col("volume")),
        ("Issue", col("issue")), ("Pages / Article number", col("pages_or_article_number")), ("Zotero item key", col("zotero_item_key")), ("Zotero attachment key", col("zotero_attachment_key")),
        ("Zotero collection", col("zotero_collection")), ("PDF filename", col("pdf_filename")), ("PDF path", F.replace("pdf_path", F.lit("\\"), F.lit("/"))), ("Images", F.lit("omitted")), ("Extraction status", col("extraction_status")),
    ]
    found = [
        ("PDF pages", col("pdf_pages")), ("Extracted characters", col("extracted_characters")), ("Text extraction method", col("method")), ("Detected layout", col("layout")),
        ("Tables extracted", F.lit("unknown")), ("Equations extracted", F.lit("unknown")), ("References extracted", col("references_extracted")),
    ]
    warnings = F.when(F.size("warnings") > 0, col("warnings")).otherwise(F.array(F.lit("")))
    sections = F.array_join(F.transform("sections", lambda s: F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["heading"]), tx.empty_to_null(tx.strip(s["text"])))), "\n\n")
    chunk = lambda c: _blocks(
        F.concat(F.lit("### Chunk "), c["chunk_id"]), "",
        _listed("*", [("Source section", F.array_join(c["heading_path"], " > ")), ("Pages", c["pages"]), ("Approx tokens", c["approx_tokens"]), ("Chunk type", c["chunk_type"]), ("Key terms", F.array_join(c["key_terms"], ", "))]),
        "", c["text"], "",
    )
    claim = lambda c: _blocks(
        _listed("*", [("Claim ID", c["claim_id"])]), "", _listed("  *", [("Claim", c["claim"]), ("Evidence section", c["section"]), ("Pages", c["pages"]), ("Type", c["type"])]), ""
    )
    body = _blocks(
        F.concat(F.lit("# "), F.coalesce(tx.empty_to_null("title"), F.lit("Untitled paper"))), "", FULL_TEXT, "", FROM_LIBRARY, "", "## Minimal metadata", "", _listed("*", meta), "",
        "## Extraction diagnostics", "", _listed("*", found), "* **Warnings:**", "", _each(warnings, lambda w: F.concat(F.lit("  * "), w)), "", "## Abstract", "", F.coalesce("abstract", F.lit("")), "",
        "## Keywords", "", F.when(F.size("keywords") > 0, F.concat(_each(col("keywords"), lambda k: F.concat(F.lit("* "), k)), F.lit("\n"))).otherwise("* "), "",
        "## Concept map for LLM routing", "", _listed("*", [(n, F.lit(CONCEPT_VALUES.get(n, ""))) for n in CONCEPTS]), "", "## Paper body", "", sections, "",
        "## Retrieval chunks", "", F.when(F.size("chunks") > 0, _each(col("chunks"), chunk)), "", "## Claim units", "", F.when(F.size("claims") > 0, _each(col("claims"), claim)), "",
    )
    return papers.select(*keep, body.alias("value"))


def file_markdown(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, value): Markdown of an extracted file.

    files: key, filename, path, status, pages, chars, method, layout, warnings array, text;
    chunks: key, chunk_no, section, page_start, page_end, approx_tokens, chunk_type, key_terms, text (page_chunks).
    """
    from ..functions import sections as sc

    c = chunks.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "section", tx.page_range("page_start", "page_end").alias("pages"), "approx_tokens", "chunk_type", "key_terms", "text"))).alias("chunks"))
    f = files.join(c, F.col(key) == F.col("_k"), "left")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    or_note = lambda label, note: F.coalesce(tx.empty_to_null(tx.section_after("text", label)), F.lit(note))
    meta = [
        ("Title", stem), ("DOI", tx.doi_strict("text")), ("Citation", F.lit("")), ("Source", F.lit("local PDF")), ("PDF filename", F.col("filename")), ("PDF path", F.col("path")), ("Images", F.lit("omitted")), ("Extraction status", F.col("status")),
    ]
    found = [
        ("PDF pages", F.col("pages")), ("Extracted characters", F.col("chars")), ("Text extraction method", F.col("method")), ("Detected layout", F.col("layout")), ("Tables extracted", F.lit("unknown")),
        ("Equations extracted", F.lit("unknown")), ("References extracted", F.when(tx.has_references("text"), "yes").otherwise("unknown")),
    ]
    warnings = F.when(F.size("warnings") > 0, F.col("warnings")).otherwise(F.array(F.lit("")))
    chunk = lambda x: _blocks(
        F.concat(F.lit("### Chunk "), F.lpad(x["chunk_no"].cast("string"), 3, "0")), "",
        _listed("-", [("Source section", x["section"]), ("Pages", x["pages"]), ("Approx tokens", x["approx_tokens"]), ("Chunk type", x["chunk_type"]), ("Key terms", F.array_join(x["key_terms"], ", "))]), "", x["text"], "",
    )
    body = _blocks(
        F.concat(F.lit("# "), stem), "", FULL_TEXT, "", FROM_FILE, "", "## Minimal metadata", "", _listed("-", meta), "", "## Extraction diagnostics", "", _listed("-", found), "- **Warnings:**",
        _each(warnings, lambda w: F.concat(F.lit("  - "), w)), "", "## Abstract", "", or_note("abstract", "_Abstract not detected in extracted PDF text._"), "", "## Keywords", "",
        or_note("keywords", "_Keywords not detected in extracted PDF text._"), "", "## Paper body", "", sc.convert_headings("text"), "", "## Retrieval chunks", "", F.when(F.size("chunks") > 0, _each(F.col("chunks"), chunk)), "",
        "## Notes for LLM use", "", *(f"- {x}" for x in LLM_NOTES), "",
    )
    return f.select(key, body.alias("value"))


def lines_markdown(files: DataFrame, keep: list[str]) -> DataFrame:
    """Markdown of a file's lines; files: title, source_file, pages, author, subject, keywords, lines array. The title defaults to the file's stem."""
    from ..functions import sections as sc

    title = F.coalesce(tx.empty_to_null("title"), F.regexp_replace("source_file", r"\.[^.]*$", ""))
    given = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"- **{name}:** "), F.col(c)))
    head = _blocks(
        F.concat(F.lit("# "), title), "", FULL_TEXT, "", FROM_LINES, "", "## Minimal metadata", "", _listed("-", [("Title", title), ("Source", F.col("source_file")), ("Pages", F.col("pages"))]),
        given("Author", "author"), given("Subject", "subject"), given("Keywords", "keywords"), "- **Images:** omitted", "",
    )
    body = F.array_join(sc.lines_to_markdown(F.col("lines")), "\n")
    return files.select(*keep, F.when(F.size("lines") > 0, F.concat_ws("\n", head, body)).otherwise(head).alias("value"))


def injected(papers: DataFrame, keep: list[str]) -> DataFrame:
    """(…, value, error): a paper's lines up to the second after ``imported_at:``, then the generated text; no such line is an error.

    papers: value, generated.
    """
    ls = tx.lines("value")
    marked = F.transform(ls, lambda x, i: F.when(F.lower(tx.strip(x)).startswith("imported_at:"), i + 1))
    at = F.array_min(F.filter(marked, lambda x: x.isNotNull()))
    head = F.regexp_replace(F.array_join(F.slice(ls, F.lit(1), F.least(at + 2, F.size(ls))), "\n"), rf"{tx.WS}+$", "")
    new = F.concat(head, F.lit("\n\n"), tx.strip("generated"), F.lit("\n"))
    return papers.select(*keep, new.alias("value"), F.when(at.isNull(), "no imported_at line").alias("error"))


def created_papers(generated: DataFrame, stored_titles: DataFrame, imported_at: str) -> DataFrame:
    """K14/J-15: (file, value) of generated texts whose title no stored paper has; of equal titles the first by path.

    generated: path, value; stored_titles: key (title_key_pipeline).
    """
    from .linking import new_rows

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    g = generated.where(tx.clean_string("value").isNotNull()).select("path", tx.strip("value").alias("value"), tx.title_from_markdown("value", stem).alias("title"))
    g = new_rows(stored_titles, g.withColumn("key", tx.title_key_pipeline("title")), ["key"], "path")
    digest = F.substring(F.sha1(F.to_binary("path", F.lit("utf-8"))), 1, 10)
    head = _blocks(
        "---", F.concat(F.lit("id: "), yaml_value(F.concat(F.lit("zotero-pdf-"), digest))), F.concat(F.lit("title: "), yaml_value(F.col("title"))), 'source: "Zotero literature pipeline"',
        F.concat(F.lit("source_pdf_markdown: "), yaml_value(F.col("path"))), F.concat(F.lit("imported_at: "), yaml_value(F.lit(imported_at))), "---",
    )
    return g.select(F.concat(tx.slug("title"), F.lit("-"), digest, F.lit(".md")).alias("file"), F.concat(head, F.lit("\n\n"), F.col("value"), F.lit("\n")).alias("value"))


def failure_report(results: DataFrame) -> DataFrame:
    """(line_no, line) of the report of failed items; results: key, error (NULL for success)."""
    from .skew import numbered

    failed = numbered(results.where("error is not null").select("key", "error"), "key", "n")
    lines = failed.select((F.col("n") + 1).cast("int").alias("line_no"), F.concat(F.lit("* **"), F.col("key"), F.lit(":** "), F.col("error")).alias("line"))
    spark = results.sparkSession
    head = [(0, "# Zotero Literature Markdown Failure Report"), (1, "")] + ([(2, "No failures.")] if failed.isEmpty() else [])
    return spark.createDataFrame(head, "line_no int, line string").unionByName(lines)


def request_trace(chunks: DataFrame, provider: str, model: str, base_url: str) -> DataFrame:
    """One JSON object per chunk of a run: what was asked of which model; secrets are no part of it. chunks: chunk, prompt."""
    return chunks.select("chunk", F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(base_url).alias("base_url"), "chunk", "prompt")).alias("value"))


def suggestion_prompt(records: DataFrame) -> DataFrame:
    """(literature_count, prompt): instructions and the literature export (id, value) as one JSON list; the export is bounded by the prompt."""
    rule = (
        'Return only JSON with this schema:\n{"suggestions":[{"proposed_label":"string","definition":"string","synonyms":["string"],'
        '"parent_class":"string or null","source_literature_ids":["string"],"confidence":"number 0..1","rationale":"string"}]}\n\nLiterature export:\n'
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"])
    return records.agg(F.count(F.lit(1)).alias("literature_count"), F.concat(F.lit(rule), F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("prompt"))


def failure_message(out: Column, err: Column, default: str = "Command failed.") -> Column:
    """What a command wrote to its error output, else to its output, else a constant."""
    return F.coalesce(tx.clean_string(err), tx.clean_string(out), F.lit(default))


def combined(blocks: DataFrame, group: str, order: str, block: str, separator: str = "\n\n---\n\n", head: Column | None = None, tail: str = "") -> DataFrame:
    """The blocks of each group in order as one text; groups are bounded by the caller's limit."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block])
    text = F.array_join(ordered, separator)
    return blocks.where(F.col(block).isNotNull()).groupBy(group).agg(F.concat(head, text, F.lit(tail)).alias("corpus") if head is not None else text.alias("corpus"), F.count(F.lit(1)).alias("blocks"))


def literature_corpus(papers: DataFrame, group: str) -> DataFrame:
    """(group, corpus, blocks) for a prompt; papers: group, file, entry_id, value."""
    name = F.element_at(F.split("file", "/"), -1)
    b = papers.select(group, "file", F.concat(F.lit("## Literature Entry: "), F.col("entry_id"), F.lit("\n\nSource file: `"), name, F.lit("`\n\n"), tx.strip("value")).alias("b"))
    return combined(b, group, "file", "b", head=F.lit("# Literature Corpus\n\n---\n\n"))


def numbered_corpus(papers: DataFrame, group: str) -> DataFrame:
    """(group, corpus, blocks) with folder, number of files and numbered documents; papers: group, file, value."""
    name = F.element_at(F.split("file", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    body = lambda x, i: F.concat(F.lit("---\n\n# Document "), (i + 1).cast("string"), F.lit(": "), x["stem"], F.lit("\n\n<!-- Source file: "), x["name"], F.lit(" -->\n\n"), x["text"], F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("file", stem.alias("stem"), name.alias("name"), tx.strip("value").alias("text"))))
    agg = papers.where("value is not null").groupBy(group).agg(ordered.alias("d"))
    head = F.concat(F.lit("# Combined Literature Markdown\n\n- Source folder: `"), F.col(group).cast("string"), F.lit("`\n- Number of files: "), F.size("d").cast("string"), F.lit("\n\n"))
    return agg.select(group, F.concat(head, F.array_join(F.transform("d", body), "\n")).alias("corpus"), F.size("d").cast("long").alias("blocks"))


def stem_corpus(papers: DataFrame, group: str) -> DataFrame:
    """(group, corpus, blocks), headings by file stem; papers: group, file, value."""
    name = F.element_at(F.split("file", "/"), -1)
    entry = F.concat(F.lit("## Literature Entry: "), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("\n\nSource file: `"), name, F.lit("`\n\n"), tx.strip("value"))
    return combined(papers.select(group, "file", entry.alias("b")), group, "file", "b", head=F.lit("# Literature Corpus\n\n---\n\n"), tail="\n")


def audit_events(df: DataFrame, details: str = "details") -> DataFrame:
    """Events with secret-looking details redacted: in a flat map, or at any depth of JSON text."""
    flat = df.schema[details].dataType.typeName() == "map"
    return df.withColumn(details, tx.redact_map(details) if flat else tx.redact_json(details))
