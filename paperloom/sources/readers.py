"""File readers: record exports, Markdown repositories, texts, ontologies, responses.

All readers are lazy DataFrames over Spark's own sources; a bad file becomes a row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured as st
from ..functions import text as tx

#: Suffixes read as text, ontology suffixes, and preferred ontology file names.
TEXT_SUFFIXES = (".txt", ".md", ".tsv", ".csv")
ONTOLOGY_SUFFIXES = (".owl", ".rdf", ".ttl", ".obo", ".tsv")


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("filename", name).withColumn("suffix", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file below the folder; texts decoded (bytes that are no UTF-8 become U+FFFD), other suffixes as metadata only.

    Only the files of a text suffix are opened; of the others Spark lists names and sizes.
    """
    raw = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    meta = ("path", "filename", "suffix", F.col("length").alias("size_bytes"))
    is_text = F.coalesce(F.col("suffix").isin(*TEXT_SUFFIXES), F.lit(False))
    texts = raw.where(is_text).select(*meta, F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return texts.unionByName(raw.where(~is_text).select(*meta, F.lit(None).cast("string").alias("content")))


def new_documents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose path is not stored."""
    return found.join(stored.select("path"), "path", "left_anti")


def inline_document(spark: SparkSession, filename: str, content: str) -> DataFrame:
    """A text given in the call, under a synthetic path."""
    name = filename if "." in filename else f"{filename}.txt"
    rows = [(f"__inline__/{name}", name, "." + name.rsplit(".", 1)[1].lower(), len(content.encode()), content)]
    return spark.createDataFrame(rows, "path string, filename string, suffix string, size_bytes long, content string")


def record_export(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, raw_id, raw, error): one row per element of each file's JSON list; a file that is no list is one row with an error.

    ``raw_id`` depends on path and position alone.
    """
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    listed = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("[")
    error = F.when(F.try_parse_json("value").isNull(), "malformed JSON").when(~listed, "not a list")
    items = F.when(listed, F.from_json("value", "array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    rows = whole.select("path", error.alias("error"), F.posexplode(items).alias("pos", "raw"))
    return rows.select("path", "pos", F.xxhash64("path", "pos").alias("raw_id"), "raw", "error")


def markdown_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the Markdown files below a folder, with unix line ends."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), tx.unix_lines("value").alias("value"))


def markdown_papers(files: DataFrame) -> DataFrame:
    """Papers of (path, value) texts, with an error for those without front matter or identity.

    Sections are the ``###`` parts of the body's information section; without one the section is one part.
    """
    v = F.col("value")
    block = st.front_matter(v)
    said = lambda k: F.coalesce(st.front_matter_value(block, k), F.lit(""))
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "")
    info = st.markdown_section(body, "Extracted ontology-relevant information")
    parts = F.split(info, r"(?md)^### ")
    section = lambda p: F.struct(tx.strip(F.split_part(p, F.lit("\n"), F.lit(1))).alias("heading"), tx.strip(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("text"))
    one = F.array(F.struct(F.lit("Extracted ontology-relevant information").alias("heading"), info.alias("text")))
    none = F.array().cast("array<struct<heading:string,text:string>>")
    sections = F.when(info == "", none).when(F.size(parts) == 1, one).otherwise(F.transform(F.slice(parts, F.lit(2), F.size(parts)), section))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    error = F.when(block.isNull(), "missing front matter")
    return files.select(
        "path", F.coalesce(tx.empty_to_null(said("id")), stem).alias("paper_id"), said("title").alias("title"), F.coalesce(st.front_matter_list(block, "authors"), F.array().cast("array<string>")).alias("authors"),
        st.front_matter_value(block, "year").alias("year"), said("doi").alias("doi"), said("pmid").alias("pmid"), said("source").alias("source"), said("url").alias("url"), said("imported_at").alias("imported_at"),
        st.markdown_section(body, "Abstract").alias("abstract"), st.markdown_section(body, "Notes").alias("notes"), sections.alias("sections"), body.alias("body"), error.alias("error"),
    )


def markdown_repository(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a folder of Markdown files; a bad file is a row with an error."""
    return markdown_papers(markdown_texts(spark, path))


def repository_status(papers: DataFrame) -> DataFrame:
    """Files, readable papers and errors of a repository."""
    return papers.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNull()).alias("papers"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def pages_of(documents: DataFrame) -> DataFrame:
    """T01 over read documents."""
    from ..functions.segments import pages

    return pages(documents, "path", "content")


_TERM = "path string, ord int, term_id string, iri string, label string, definition string, synonyms array<string>, parents array<string>"


def _obo(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, value in zip(b["path"], b["value"], strict=True):
                term, n = None, 0

                def close(t: dict | None, p: str = path) -> None:
                    nonlocal n
                    if t and t.get("id") and t.get("name"):
                        n += 1
                        rows.append((p, n, t["id"], t["id"], t["name"], t.get("def"), t["synonym"], t["is_a"]))

                for line in map(str.strip, value.splitlines()):
                    if line.startswith("[") and line.endswith("]"):
                        if line == "[Term]" or not strict:
                            close(term)
                            term = {"synonym": [], "is_a": []} if line == "[Term]" else None
                        continue
                    tag, _, rest = line.partition(": ")
                    if term is None or not rest or line.startswith("!"):
                        continue
                    rest = rest.strip()
                    if tag in ("id", "name"):
                        term[tag] = rest
                    elif tag == "def":
                        term[tag] = rest.strip('"')
                    elif tag == "synonym":
                        term[tag].append(rest.split('"')[1] if '"' in rest else rest)
                    elif tag == "is_a":
                        term[tag].append(rest.split()[0])
                close(term)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TERM.split(", ")])

    return run


def obo_terms(files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Terms of OBO texts (path, value). Other stanzas end a term; with ``strict_compat`` their
    lines go on writing into the term before them."""
    return files.select("path", "value").mapInPandas(_obo(strict_compat), _TERM)


def tsv_terms(files: DataFrame) -> DataFrame:
    """Terms of template tables (path, value) by the first filled header alias; template rows are skipped."""
    aliases = {
        "label": ("LABEL", "label", "rdfs:label", "A rdfs:label"), "id": ("ID", "id", "term_id"), "synonyms": ("synonyms", "SYNONYMS", "A oboInOwl:hasExactSynonym"),
        "definition": ("definition", "DEFINITION", "A IAO:0000115"), "parents": ("parent", "PARENT", "SC %"),
    }
    ls = F.filter(F.split(tx.unix_lines("value"), "\n"), lambda x: x != "")
    d = files.select("path", F.split(F.get(ls, F.lit(0)), "\t").alias("head"), F.posexplode(F.slice(ls, F.lit(2), F.size(ls))).alias("ord", "line"))
    cell = lambda n: tx.clean_string(F.get(F.split("line", "\t"), (F.array_position("head", F.lit(n)) - 1).cast("int")))
    pick = lambda k: F.coalesce(*(F.when(F.array_contains("head", F.lit(n)), cell(n)) for n in aliases[k]))
    d = d.select("path", "ord", pick("label").alias("label"), pick("id").alias("id"), pick("definition").alias("definition"), pick("synonyms").alias("s"), pick("parents").alias("p"))
    d = d.where(F.col("label").isNotNull() & ~F.col("label").startswith("A "))
    ident = F.coalesce("id", "label")
    return d.select("path", F.col("ord") + 1, ident.alias("term_id"), ident.alias("iri"), "label", "definition", tx.multi_value("s").alias("synonyms"), tx.multi_value("p").alias("parents")).toDF(*[c.split()[0] for c in _TERM.split(", ")])


def triple_terms(triples: DataFrame) -> DataFrame:
    """Terms of (s, p, o, o_kind) rows: classes or labelled subjects with an IRI.

    First label in subject order; definition by the annotation property, else the note property;
    exact before related synonyms; IRI parents only, shortened.
    """
    own = {"label": "label", "definition": "IAO_0000115", "note": "definition", "exact": "hasExactSynonym", "related": "hasRelatedSynonym"}
    t = triples.withColumn("name", tx.local_name("p")).where(F.col("s").startswith("http"))
    subjects = t.where(((F.col("name") == "type") & (tx.local_name("o") == "Class")) | (F.col("name") == "label")).select("s").distinct()
    agg = t.join(subjects, "s").groupBy("s").agg(
        *(F.min(F.when((F.col("name") == v) & (F.col("o") != ""), F.col("o"))).alias(k) for k, v in own.items() if k in ("label", "definition", "note")),
        F.array_sort(F.collect_list(F.when(F.col("name") == own["exact"], F.col("o")))).alias("exact"),
        F.array_sort(F.collect_list(F.when(F.col("name") == own["related"], F.col("o")))).alias("related"),
        F.array_sort(F.collect_list(F.when((F.col("name") == "subClassOf") & (F.col("o_kind") == "iri"), tx.local_name("o")))).alias("parents"),
    )
    return agg.select(tx.local_name("s").alias("term_id"), F.col("s").alias("iri"), F.coalesce("label", tx.local_name("s")).alias("label"), F.coalesce("definition", "note").alias("definition"), F.concat("exact", "related").alias("synonyms"), "parents")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of response files, for parse_candidates."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def pdf_listing(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of any suffix case, one per case-folded path, sorted."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF,Pdf}").load(path).select("path", "length")
    return d.groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("path"), F.min_by("length", "path").alias("size_bytes")).drop("k").orderBy("path")


def ontology_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, suffix, size_bytes, kind) of the ontology files below a folder; a TSV file is a template."""
    d = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length"))
    kind = F.when(F.col("suffix") == ".tsv", "robot_template").otherwise("ontology")
    return d.where(F.col("suffix").isin(*ONTOLOGY_SUFFIXES)).select("path", F.col("filename").alias("name"), "suffix", F.col("length").alias("size_bytes"), kind.alias("kind")).orderBy("path")


def ontology_terms(spark: SparkSession, path: str, most: int | None = None, strict_compat: bool = False) -> DataFrame:
    """The terms of one OBO, TSV or N-Triples file by its suffix; another suffix is an error.

    RDF/XML and Turtle need a library that is not at hand: convert them to N-Triples first.
    """
    suffix = path[path.rfind(".") :].lower() if "." in path else ""
    if suffix not in (".obo", ".tsv", ".nt"):
        raise ValueError(f"unsupported ontology file type: {suffix}")
    files = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value")
    if suffix == ".obo":
        terms = obo_terms(files, strict_compat)
    elif suffix == ".tsv":
        terms = tsv_terms(files)
    else:
        terms = triple_terms(triples(files))
    return terms.orderBy("ord" if "ord" in terms.columns else "iri").limit(most) if most is not None else terms


def triples(files: DataFrame) -> DataFrame:
    """(s, p, o, o_kind) of N-Triples texts (path, value)."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|\"((?:[^\"\\]|\\.)*)\"\S*|(_:\S+))\s*\.\s*$"
    part = lambda n: F.regexp_extract("line", pattern, n)
    d = files.select(F.explode(F.split(tx.unix_lines("value"), "\n")).alias("line")).where(F.col("line").rlike(pattern))
    text = F.replace(F.replace(F.replace(part(4), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    kind = F.when(part(3) != "", "iri").when(part(5) != "", "blank").otherwise("literal")
    return d.select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), F.when(kind == "iri", part(3)).when(kind == "blank", part(5)).otherwise(text).alias("o"), kind.alias("o_kind"))


#: Built-in sample records.
SAMPLES = (
    (1, "zotero", "SAMPLE001", "Sample record of a controlled vocabulary", "2024"),
    (2, "zotero", "SAMPLE002", "Sample record of a term list", "2023"),
)


def sample_sources(spark: SparkSession) -> DataFrame:
    """Constant records to try the queries with."""
    return spark.createDataFrame([*SAMPLES], "id long, provider string, provider_item_key string, title string, year string")


def check_inputs(prompt: str, ontology: DataFrame, literature: DataFrame) -> list[str]:
    """What is missing for a curation run; ontology and literature: path, size_bytes of the files found."""
    problems = [] if prompt and prompt.strip() else ["empty prompt"]
    for name, files, suffix in (("ontology", ontology, ".obo"), ("literature", literature, None)):
        f = files.limit(1).collect()
        if not f:
            problems.append(f"{name} not found")
        elif suffix and not f[0].path.lower().endswith(suffix):
            problems.append(f"{name} is no {suffix} file")
        elif not f[0].size_bytes:
            problems.append(f"{name} is empty")
    return problems


# --- pages of PDF files: any library can fill the blocks; what follows is independent of it -----------


def pdf_pages(files: DataFrame, read_pages) -> DataFrame:
    """(path, page_number, text, error): the pages that a given function reads from a file's bytes.

    files: path, content (binary). ``read_pages(bytes) -> list[str]`` wraps a PDF library; a file that it cannot
    read is one row with an error and no text. The bytes of one file at a time are in a worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, t, None) for n, t in enumerate(read_pages(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001 - an unreadable file is a row
                    rows.append((path, 0, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")


def reading_order(blocks: DataFrame) -> DataFrame:
    """(path, page_number, text): text blocks of a page in reading order.

    blocks: path, page_number, page_width, x0, y0, x1, text. Blocks wider than 65 % of the page come first; then,
    if both halves hold blocks, the left column before the right one, else all by position.
    """
    b = blocks.where(tx.clean_string("text").isNotNull())
    wide = (F.col("x1") - F.col("x0")) > F.col("page_width") * 0.65
    half = F.when(wide, 0).when(F.col("x0") < F.col("page_width") / 2, 1).otherwise(2)
    grouped = b.groupBy("path", "page_number").agg(F.collect_list(F.struct(half.alias("half"), "y0", "x0", "text")).alias("b"))
    both = F.exists("b", lambda x: x["half"] == 1) & F.exists("b", lambda x: x["half"] == 2)
    column = lambda x: F.when((x["half"] == 2) & ~both, 1).otherwise(x["half"])
    ordered = F.array_sort(F.transform("b", lambda x: F.struct(column(x).alias("column"), x["y0"].alias("y0"), x["x0"].alias("x0"), x["text"].alias("text"))))
    return grouped.select("path", "page_number", tx.whitespace_a(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("text"))


def extraction_status(pages: DataFrame, key: str = "path", least: int = 500) -> DataFrame:
    """(key, pages, chars, status): complete from ``least`` characters on, else partial_or_empty; failed if the file could not be read."""
    p = pages.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.max("error").alias("error"))
    return p.select(key, "pages", "chars", F.when(F.col("error").isNotNull(), "failed").when(F.col("chars") >= least, "complete").otherwise("partial_or_empty").alias("status"))


def page_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, page_number, line_no, line): filled lines of cleaned pages."""
    ls = F.filter(F.transform(tx.lines(tx.clean_pdf_text("text")), tx.strip), lambda x: x != "")
    return pages.where("text is not null").select(key, "page_number", F.posexplode(ls).alias("line_no", "line"))


def storage_summary(files: DataFrame, show: int = 20) -> DataFrame:
    """Folders, folders with PDF files, PDF files, and the first paths. files: path."""
    d = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.lower("path").endswith(".pdf").alias("pdf"))
    first = [r.path for r in d.where("pdf").orderBy("path").limit(show).collect()]
    return d.agg(F.count_distinct("folder").alias("folders"), F.count_distinct(F.when(F.col("pdf"), F.col("folder"))).alias("folders_with_pdf"), F.count_if("pdf").alias("pdfs")).withColumn("first", F.array(*map(F.lit, first)) if first else F.array().cast("array<string>"))


def attachment_counts(items: DataFrame, attachments: DataFrame, files: DataFrame) -> DataFrame:
    """J-16: items, their attachments, the storage folders and PDF files found. items: key; attachments: key, parent; files: folder, path."""
    a = attachments.join(items.select(F.col("key").alias("parent")), "parent", "left_semi")
    f = files.join(a.select(F.col("key").alias("folder")), "folder", "left_semi")
    one = lambda df, name, c: df.agg(c.alias(name))
    out = one(items, "items", F.count(F.lit(1)))
    for part in (one(a, "attachments", F.count(F.lit(1))), f.agg(F.count_distinct("folder").alias("folders"), F.count(F.lit(1)).alias("pdfs"))):
        out = out.join(part, how="cross")  # one row each
    return out


def items_with_pdf(items: DataFrame, attachments: DataFrame, files: DataFrame) -> DataFrame:
    """J-16/M19: the items that have a PDF file through any attachment."""
    have = attachments.join(files.select(F.col("folder").alias("key")).distinct(), "key", "left_semi").select(F.col("parent").alias("key")).distinct()
    return items.join(have, "key", "left_semi")
