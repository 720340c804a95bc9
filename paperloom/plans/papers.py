"""Queries on papers, sections, contracts, readers and stored rows, each with its SQL where SQL can give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rc
from ..functions import sections as sc
from ..functions import similarity as sim
from ..functions import structured as st
from ..functions import text as tx
from ..operators import exports, linking, papers, review, vocabulary
from ..sources import readers
from ..session import spread, table
from .catalogue import WS, _collapse, _dehyphen, _doi, _heading, _lines, _pk, _strip, _words
from .registry import register

_none = "CAST([] AS VARCHAR[])"


def _when(*pairs: tuple[str, str]) -> str:
    """SQL: the codes whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


# --- contracts ------------------------------------------------------------------------------------

_suggested = {"suggestion_type": "review_status", "proposed_label": "label", "existing_ontology_id": "NULL", "proposed_definition": "proposed_definition", "parent_class": "proposed_parent"}


@register(
    f"""SELECT id, list_sort({_when(*((f"missing:{k}", f"{v} IS NULL") for k, v in _suggested.items()), *((f"missing:{k}", "true") for k in ("relations", "source_literature_ids", "supporting_quotes_or_summaries", "rationale")), ("missing:synonyms", "synonyms IS NULL"))})
    || {_when(("confidence", "confidence_score IS NULL OR NOT confidence_score BETWEEN 0 AND 0.9"))} AS problems FROM (SELECT * REPLACE (CASE WHEN confidence_score <= 0.9 THEN confidence_score END AS confidence_score) FROM candidate_terms)"""
)
def suggestion_problems(s, d):
    """Candidates as suggestion objects; NULL fields are absent, scores over 0.9 are written as text."""
    t = table(s, d, "candidate_terms")
    score = F.when(F.col("confidence_score") <= 0.9, F.col("confidence_score").cast("string")).otherwise(F.concat(F.lit('"'), F.col("confidence_score").cast("string"), F.lit('"')))
    body = F.to_json(F.struct(F.col("review_status").alias("suggestion_type"), F.col("label").alias("proposed_label"), "proposed_definition", "synonyms", F.col("proposed_parent").alias("parent_class")))
    raw = F.concat(F.left(body, F.length(body) - 1), F.when(body == "{}", "").otherwise(","), F.coalesce(F.concat(F.lit('"confidence":'), score), F.lit('"confidence":null')), F.lit("}"))
    return t.select("id", st.suggestion_problems(raw).alias("problems"))


@register(
    f"""SELECT id, list_sort({_when(("missing:proposed_label", "label IS NULL"), ("missing:definition", "proposed_definition IS NULL"), ("missing:synonyms", "synonyms IS NULL"), ("missing:confidence", "confidence_score IS NULL"), ("missing:rationale", "proposed_parent IS NULL"))})
    || {_when(("not_a_list:source_literature_ids", "true"), ("confidence", "confidence_score IS NULL OR NOT confidence_score BETWEEN 0 AND 1"))} AS problems FROM candidate_terms"""
)
def payload_problems(s, d):
    """Candidates as payload suggestions whose literature ids are text, not a list."""
    t = table(s, d, "candidate_terms")
    raw = F.to_json(F.struct(F.col("label").alias("proposed_label"), F.col("proposed_definition").alias("definition"), "synonyms", F.lit("x").alias("source_literature_ids"), F.col("confidence_score").alias("confidence"), F.col("proposed_parent").alias("rationale")))
    return t.select("id", st.payload_problems(raw).alias("problems"))


@register("SELECT id, list_sort(list_filter(['candidate_id', CASE WHEN review_status IS NOT NULL THEN 'review_status' END], lambda x: x IS NOT NULL)) AS extra FROM candidate_terms")
def unknown_keys(s, d):
    t = table(s, d, "candidate_terms")
    return t.select("id", st.unknown_keys(F.to_json(F.struct("candidate_id", "label", "synonyms", "review_status", "confidence_score"))).alias("extra"))


# --- records of both shapes -----------------------------------------------------------------------


def _api(s, d):
    """The stored records as API records: names by first and last name, tags as objects, the citation key in free text."""
    t = table(s, d, "literature_sources")
    people = F.transform("creators", lambda c: F.struct(c["family"].alias("lastName"), c["given"].alias("firstName"), c["type"].alias("creatorType")))
    data = F.struct(
        "title", F.col("item_type").alias("itemType"), people.alias("creators"), F.col("year").alias("date"), F.col("doi").alias("DOI"), "url", F.col("abstract").alias("abstractNote"),
        F.transform("tags", lambda x: F.struct(x.alias("tag"))).alias("tags"), F.concat(F.lit("Call Number: 1\nCitation Key: "), F.col("citation_key")).alias("extra"), "collections",
    )
    return t.select(F.col("id").alias("row_id"), F.to_json(F.struct(F.col("provider_item_key").alias("key"), F.col("zotero_version").alias("version"), data.alias("data"))).alias("raw"))


_clean = lambda x: f"nullif({_strip(x)}, '')"
_texts = lambda x: f"list_filter(list_transform(coalesce({x}, {_none}), lambda t: {_clean('t')}), lambda t: t IS NOT NULL)"


@register(
    f"""SELECT id AS row_id, true AS api, {_clean('provider_item_key')} AS provider_item_key, {_clean('citation_key')} AS citation_key, {_clean('title')} AS title, {_clean('item_type')} AS item_type,
    list_transform(coalesce(creators, []), lambda c: {_clean('c.family')} || '') AS families, nullif(regexp_extract({_clean('year')}, '\\d{{4}}', 0), '') AS year, {_doi(_clean('doi'))} AS doi, {_clean('url')} AS url, {_clean('abstract')} AS abstract,
    {_texts('tags')} AS tags, {_texts('collections')} AS collections, zotero_version AS version FROM literature_sources
    WHERE {_clean('title')} IS NOT NULL AND coalesce(item_type, '') NOT IN ('attachment', 'note', 'annotation')"""
)
def api_records(s, d):
    """API records read back."""
    r = rc.source_records(_api(s, d), "row_id")
    return r.withColumn("families", F.transform("creators", lambda c: c["family"])).drop("creators")


@register(
    f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN item_type IN ('attachment', 'note', 'annotation') THEN 'not_a_paper' WHEN {_clean('title')} IS NULL THEN 'no_title' ELSE 'record' END AS outcome FROM literature_sources
    UNION ALL SELECT CASE WHEN NOT json_valid(raw) THEN 'malformed' WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' WHEN {_clean("json_extract_string(raw, '$.title')")} IS NULL THEN 'no_title' ELSE 'record' END FROM csl_items) GROUP BY 1"""
)
def record_outcomes(s, d):
    """S04/P05 over records of both shapes in one table."""
    own = table(s, d, "csl_items").select(F.col("raw_id").alias("row_id"), "raw")
    return rc.record_outcomes(_api(s, d).unionByName(own), "row_id")


@register(
    f"""SELECT id AS row_id, coalesce({_clean('title')}, 'Untitled paper') AS title, coalesce({_clean('doi')}, '') AS doi, coalesce(nullif(regexp_extract({_clean('year')}, '(?:19|20)\\d{{2}}', 0), ''), '') AS year,
    len(list_filter(coalesce(creators, []), lambda c: coalesce(c.type, 'author') = 'author' AND coalesce({_clean('c.given')}, {_clean('c.family')}) IS NOT NULL)) AS authors, {_texts('tags')} AS keywords FROM literature_sources"""
)
def item_metadata(s, d):
    """M18."""
    m = rc.paper_metadata(_api(s, d), "row_id")
    return m.select("row_id", "title", "doi", "year", F.size("authors").cast("long").alias("authors"), "keywords")


# --- papers ---------------------------------------------------------------------------------------

_norm = lambda x: f"nullif({_strip(f'''regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')''')}, '')"
_key_ok = "coalesce(regexp_matches(provider_item_key, '^[A-Za-z0-9]{6,14}$'), false)"
_pid = lambda key_ok, doi, other: f"CASE WHEN {key_ok} THEN 'zotero-' || provider_item_key WHEN length({doi}) > 0 THEN 'doi-' || substr(sha1(lower({doi})), 1, 12) ELSE 'paper-' || substr(sha1(lower(coalesce(nullif({other}, ''), 'unknown'))), 1, 12) END"
_papers_sql = f"""
    f AS (SELECT source_id, count(*) AS files, arg_min(path, id) AS first_path, bool_or({_norm('content')} IS NOT NULL) AS has_text, bool_or(suffix = '.pdf' AND coalesce(content, '') = '') AS scanned, sum(coalesce(length({_norm('content')}), 0)) AS chars
      FROM literature_documents WHERE source_id IS NOT NULL GROUP BY 1),
    c AS (SELECT provider_item_key AS k, count(*) AS copies FROM literature_sources WHERE provider_item_key IS NOT NULL GROUP BY 1),
    p AS (SELECT 'source' AS kind, id, {_pid(_key_ok, 'doi', 'coalesce(first_path, title)')} AS paper_id, CASE WHEN {_key_ok} THEN provider_item_key END AS item_key,
      CASE WHEN {_key_ok} AND copies = 1 THEN 'zotero://select/library/items/' || provider_item_key END AS uri,
      CASE WHEN coalesce(provider_item_key, '') = '' THEN 'missing_key' WHEN NOT {_key_ok} THEN 'malformed_key' WHEN copies > 1 THEN 'duplicate_key' END AS diagnostic, title,
      coalesce(files, 0) AS files, CASE WHEN coalesce(has_text, false) THEN 'success' ELSE 'missing_text' END AS status, CAST(coalesce(chars, 0) AS BIGINT) AS chars, coalesce(abstract, '') <> '' AS has_abstract,
      list_sort({_when(("missing_title", "coalesce(title, '') = ''"), ("missing_attachment", "files IS NULL"), ("missing_full_text", "NOT coalesce(has_text, false)"), ("missing_text_content", "NOT coalesce(has_text, false) AND coalesce(abstract, '') = ''"), ("possible_scanned_pdf", "coalesce(scanned, false)"))}) AS quality_flags
      FROM literature_sources s LEFT JOIN f ON s.id = f.source_id LEFT JOIN c ON c.k = provider_item_key
    UNION ALL SELECT 'document', id, 'paper-' || substr(sha1(lower(coalesce(nullif(path, ''), 'unknown'))), 1, 12), NULL, NULL, 'missing_key', d.filename, 1, CASE WHEN t IS NULL THEN 'missing_text' ELSE 'success' END, coalesce(length(t), 0), false,
      list_sort({_when(("missing_title", "coalesce(fn, '') = ''"), ("missing_full_text", "t IS NULL"), ("missing_text_content", "t IS NULL"), ("possible_scanned_pdf", "coalesce(suffix = '.pdf' AND coalesce(content, '') = '', false)"))})
      FROM (SELECT *, d.filename AS fn, {_norm('content')} AS t FROM literature_documents d WHERE source_id IS NULL) d)"""


@register(f"WITH {_papers_sql} SELECT * FROM p")
def source_papers(s, d):
    """M01/M03/E04."""
    p = papers.source_papers(table(s, d, "literature_sources"), table(s, d, "literature_documents"))
    return p.select("kind", "id", "paper_id", "item_key", "uri", "diagnostic", "title", F.size("attachments").cast("long").alias("files"), "status", "chars", "has_abstract", "quality_flags")


@register(
    f"""WITH {_papers_sql}, n AS (SELECT paper_id, count(*) AS n FROM p GROUP BY 1)
    SELECT kind, id, unnest({_when(("no_paper_id", "coalesce(paper_id, '') = ''"), ("repeated_paper_id", "n > 1"), ("uri_without_key", "NOT contains(uri, item_key)"), ("no_text_without_flag", "chars = 0 AND NOT has_abstract AND NOT list_contains(quality_flags, 'missing_full_text')"))}) AS violation FROM p JOIN n USING (paper_id)"""
)
def payload_violations(s, d):
    """J09."""
    return papers.payload_violations(papers.source_papers(table(s, d, "literature_sources"), table(s, d, "literature_documents")))


@register(
    f"SELECT source_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY id)) AS full_text FROM (SELECT source_id, id, {_norm('content')} AS t FROM literature_documents WHERE source_id IS NOT NULL) WHERE t IS NOT NULL GROUP BY 1"
)
def full_texts(s, d):
    """M02."""
    return papers.full_texts(table(s, d, "literature_documents")).select("source_id", F.md5("full_text").alias("full_text"))


@register(
    f"""WITH f AS (SELECT source_id, bool_or({_clean('content')} IS NOT NULL) AS has_text, bool_or(suffix = '.pdf' AND coalesce(content, '') = '') AS scanned FROM literature_documents WHERE source_id IS NOT NULL GROUP BY 1)
    SELECT id, list_sort({_when(("missing_title", "coalesce(title, '') = ''"), ("missing_attachment", "source_id IS NULL"), ("missing_full_text", "NOT coalesce(has_text, false) AND coalesce(abstract, '') = ''"), ("possible_scanned_pdf", "coalesce(scanned, false)"))}) AS quality_flags
    FROM literature_sources LEFT JOIN f ON id = source_id"""
)
def listing_flags(s, d):
    """F42, second variant."""
    return papers.source_text_flags(table(s, d, "literature_sources"), table(s, d, "literature_documents"))


_person = "concat_ws(' ', nullif(c.given, ''), nullif(c.family, ''))"


@register(
    f"""SELECT path, octet_length(encode(body)) AS size_bytes, source_id, md5(body) AS body FROM (SELECT '__source__/' || id AS path, id AS source_id, concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(array_to_string(list_filter(list_transform(creators, lambda c: nullif({_person}, '')), lambda n: n IS NOT NULL), '; '), ''), nullif(abstract, ''), nullif(doi, ''), nullif(url, '')) AS body FROM literature_sources)"""
)
def sentinel_documents(s, d):
    """U04/U05."""
    t = papers.sentinel_documents(table(s, d, "literature_sources"), table(s, d, "literature_documents"))
    return t.select("path", "size_bytes", "source_id", F.md5("content").alias("body"))


_refs = "('references', 'bibliography', 'literature_cited')"


@register(
    f"""SELECT section_id, md5({_strip("regexp_replace(coalesce(text, ''), '(?im)^\\s*(?:references|bibliography|literature cited)\\s*$(?s:.*)', '')")}) AS text FROM sections_flat
    WHERE heading_path IS NOT NULL AND len(list_filter(heading_path, lambda h: {_heading('h')} IN {_refs})) = 0 AND NOT (len(heading_path) = 1 AND coalesce({_heading('heading')}, '') = 'abstract')"""
)
def readable_sections(s, d):
    """J12."""
    return papers.readable_sections(table(s, d, "sections_flat")).select("section_id", F.md5("text").alias("text"))


@register("SELECT d.id, d.filename, CASE WHEN s.id IS NOT NULL THEN coalesce(nullif(s.citation_key, ''), nullif(s.provider_item_key, ''), CAST(s.id AS VARCHAR)) END AS source_label FROM literature_documents d LEFT JOIN literature_sources s ON s.id = d.source_id")
def labelled_documents(s, d):
    """J-13."""
    return papers.labelled_documents(table(s, d, "literature_documents"), table(s, d, "literature_sources"))


@register(
    f"""SELECT meta_id, coalesce(nullif(substr(lower(regexp_replace(regexp_replace(coalesce(nullif(doi, ''), nullif(title, ''), nullif(citation, ''), 'literature'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80), ''), 'literature') AS paper_id FROM paper_metadata"""
)
def synthetic_ids(s, d):
    """M16."""
    return table(s, d, "paper_metadata").select("meta_id", papers.synthetic_id(F.col("doi"), F.col("title"), F.col("citation")).alias("paper_id"))


@register(
    f"SELECT candidate_id, document_id, label, {_collapse('lower(label)')} AS normalized_label, coalesce(synonyms, {_none}) AS synonyms, confidence_score, review_status, CAST(coalesce(len(evidence), 0) AS INTEGER) AS evidence_count, evidence[1].quoted_text AS first_quote FROM candidate_terms"
)
def candidate_payloads(s, d):
    """F43/M07."""
    return papers.candidate_payload(table(s, d, "candidate_terms"))


# --- corpora and rendered files -------------------------------------------------------------------


def _blocks(s, d):
    t = table(s, d, "sections_flat").where("paper_key is not null and text is not null")
    return t.select("paper_key", F.concat(F.lit("papers/"), F.lpad(F.col("section_id").cast("string"), 9, "0"), F.lit(".md")).alias("file"), F.col("section_id").cast("string").alias("entry_id"), F.col("text").alias("value"))


_file = "lpad(CAST(section_id AS VARCHAR), 9, '0')"
_b = f"WITH b AS (SELECT paper_key, section_id, {_file} AS stem, {_strip('text')} AS t, row_number() OVER (PARTITION BY paper_key ORDER BY section_id) AS n FROM sections_flat WHERE paper_key IS NOT NULL AND text IS NOT NULL)"
_entry = lambda name: f"'## Literature Entry: ' || {name} || chr(10) || chr(10) || 'Source file: `' || stem || '.md`' || chr(10) || chr(10) || t"
_rule = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@register(f"{_b} SELECT paper_key, md5('# Literature Corpus' || {_rule} || string_agg({_entry('CAST(section_id AS VARCHAR)')}, {_rule} ORDER BY section_id)) AS corpus, count(*) AS blocks FROM b GROUP BY 1")
def literature_corpus(s, d):
    """K07."""
    return exports.literature_corpus(_blocks(s, d), "paper_key").withColumn("corpus", F.md5("corpus"))


@register(
    f"""{_b} SELECT paper_key, md5('# Combined Literature Markdown' || chr(10) || chr(10) || '- Source folder: `' || paper_key || '`' || chr(10) || '- Number of files: ' || count(*) || chr(10) || chr(10)
    || string_agg('---' || chr(10) || chr(10) || '# Document ' || n || ': ' || stem || chr(10) || chr(10) || '<!-- Source file: ' || stem || '.md -->' || chr(10) || chr(10) || t || chr(10), chr(10) ORDER BY section_id)) AS corpus, count(*) AS blocks FROM b GROUP BY 1"""
)
def numbered_corpus(s, d):
    """K08."""
    return exports.numbered_corpus(_blocks(s, d), "paper_key").withColumn("corpus", F.md5("corpus"))


@register(f"{_b} SELECT paper_key, md5('# Literature Corpus' || {_rule} || string_agg({_entry('stem')}, {_rule} ORDER BY section_id) || chr(10)) AS corpus, count(*) AS blocks FROM b GROUP BY 1")
def stem_corpus(s, d):
    """K09."""
    return exports.stem_corpus(_blocks(s, d), "paper_key").withColumn("corpus", F.md5("corpus"))


@register(
    f"SELECT id, md5('---' || chr(10) || 'imported_at: x' || chr(10) || 'source: y' || chr(10) || '---' || chr(10) || chr(10) || {_strip('content')} || chr(10)) AS value, CAST(NULL AS VARCHAR) AS error FROM literature_documents WHERE content IS NOT NULL"
)
def injected_papers(s, d):
    """Each text put behind a paper's front matter."""
    t = table(s, d, "literature_documents").where("content is not null")
    old = F.lit("---\nimported_at: x\nsource: y\n---\n\nbody of the paper\n")
    return exports.injected(t.select("id", old.alias("value"), F.col("content").alias("generated")), ["id"]).select("id", F.md5("value").alias("value"), "error")


_mdt = "coalesce(nullif(regexp_extract(value, '(?m)^title:\\s*\"?(.*?)\"?\\s*$', 1), ''), nullif(regexp_extract(value, '(?m)^#\\s+(.+?)\\s*$', 1), ''), regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''))"
_slug = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'untitled')"


@register(
    f"""WITH g AS (SELECT path, {_strip('content')} AS value FROM literature_documents WHERE {_clean('content')} IS NOT NULL), t AS (SELECT *, {_mdt} AS title FROM g), k AS (SELECT *, {_pk('title')} AS key FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS r FROM k WHERE key NOT IN (SELECT {_pk('title')} FROM literature_sources WHERE title IS NOT NULL))
    SELECT {_slug} || '-' || substr(sha1(path), 1, 10) || '.md' AS file, length(value) AS chars FROM r WHERE r = 1"""
)
def created_papers(s, d):
    """K14/J-15."""
    g = table(s, d, "literature_documents").select("path", F.col("content").alias("value"))
    titles = table(s, d, "literature_sources").where("title is not null").select(tx.title_key_pipeline("title").alias("key"))
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n\n", "")
    return exports.created_papers(g, titles, "2024-01-01T00:00:00+00:00").select("file", (F.length(body) - 1).cast("long").alias("chars"))


@register()
def full_papers(s, d):
    """Library metadata rendered with no sections of its own."""
    m = table(s, d, "paper_metadata")
    none = lambda t: F.array().cast(f"array<struct<{t}>>")
    p = m.withColumns(
        {
            "extraction_status": F.lit("complete"), "pdf_pages": F.lit(1), "extracted_characters": F.length("abstract"), "method": F.lit("given"), "layout": F.lit("unknown"), "references_extracted": F.lit("no"),
            "warnings": F.array().cast("array<string>"), "sections": F.array(F.struct(F.lit("Abstract").alias("heading"), F.lit(2).alias("level"), F.coalesce("abstract", F.lit("")).alias("text"))),
            "chunks": none("chunk_id:string,heading_path:array<string>,pages:string,approx_tokens:int,chunk_type:string,key_terms:array<string>,text:string"), "claims": none("claim_id:string,claim:string,section:string,pages:string,type:string"),
        }
    )
    return exports.full_paper_markdown(p, ["meta_id"]).select("meta_id", F.length("value").alias("chars"), F.md5("value").alias("rendered"))


@register()
def file_papers(s, d):
    """Extracted files with their page chunks."""
    pages = table(s, d, "extracted_pages")
    f = sc.ordered_pages(pages).select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), F.size("pages").alias("pages"))
    names = table(s, d, "literature_documents").select(F.col("id").alias("doc_id"), "filename", "path")
    f = f.join(names, "doc_id").select("doc_id", "filename", "path", F.when(F.length("text") >= 500, "complete").otherwise("partial_or_empty").alias("status"), "pages", F.length("text").alias("chars"), F.lit("given").alias("method"), tx.layout_by_lines("text").alias("layout"), F.array().cast("array<string>").alias("warnings"), "text")
    return exports.file_markdown(f, sc.page_chunks(pages), "doc_id").select("doc_id", F.md5("value").alias("rendered"))


@register()
def line_papers(s, d):
    """Pages as section Markdown."""
    pages = table(s, d, "extracted_pages").where("text is not null")
    ls = readers.page_lines(pages, "doc_id").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line"))), lambda x: x["line"]).alias("lines"), F.count_distinct("page_number").alias("pages"))
    blank = F.lit(None).cast("string")
    f = ls.select("doc_id", "lines", "pages", blank.alias("title"), F.concat("doc_id", F.lit(".pdf")).alias("source_file"), blank.alias("author"), blank.alias("subject"), blank.alias("keywords"))
    return exports.lines_markdown(f, ["doc_id"]).select("doc_id", F.md5("value").alias("rendered"))


# --- sections -------------------------------------------------------------------------------------

_canon = ", ".join(f"'{x}'" for x in sc.CANONICAL)
_small = ", ".join(f"'{x}'" for x in sc.SMALL_WORDS)
_hints = " OR ".join(f"contains({_heading('x')}, '{h}')" for h in sc.HEADING_HINTS)
_numre = "'^(\\d+(?:\\.\\d+)*)\\.?\\s+(.+?)\\s*$'"
_tree = f"""WITH l AS (SELECT id, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM (SELECT id, regexp_split_to_array(content, '{tx.LINE_END}') AS ls FROM literature_documents WHERE content IS NOT NULL)),
    t AS (SELECT id, pos, {_strip('raw')} AS x FROM l), f AS (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM t WHERE x <> ''),
    n AS (SELECT *, regexp_extract(x, {_numre}, 1) AS num, {_strip(f"regexp_extract(x, {_numre}, 2)")} AS body, {_words('x')} AS ws FROM f),
    h AS (SELECT *, num <> '' AND length(body) <= 120 AND len({_words('body')}) <= 12 AND NOT regexp_matches(body, '\\(\\d{{4}}\\)') AND NOT (contains(body, ',') AND NOT contains(num, '.')) AS numbered, {_heading('x')} IN ({_canon}) AS canonical,
      coalesce(length(x) <= 90 AND len(ws) BETWEEN 2 AND 10 AND NOT regexp_matches(x, '[.,;:]$') AND regexp_matches(x, '\\p{{L}}') AND len({_words('nxt')}) >= 5
        AND (len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}') OR lower(w) IN ({_small}))) / len(ws) >= 0.65 OR (({_hints}) AND length(nxt) >= 80)), false) AS guessed FROM n),
    s AS (SELECT *, CAST(sum(CASE WHEN numbered OR canonical OR guessed THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS INTEGER) AS k, first_value(numbered OR canonical OR guessed) OVER (PARTITION BY id ORDER BY pos) AS starts FROM h),
    g AS (SELECT id, k, any_value(starts) AS starts, max(CASE WHEN numbered THEN 1 + length(num) - length(replace(num, '.', '')) WHEN canonical OR guessed THEN 1 ELSE 0 END) AS level,
      max(CASE WHEN numbered THEN body WHEN canonical OR guessed THEN x END) AS heading, string_agg(CASE WHEN NOT (numbered OR canonical OR guessed) THEN x END, ' ' ORDER BY pos) AS text FROM s GROUP BY 1, 2),
    q AS (SELECT id, k - CASE WHEN starts THEN 1 ELSE 0 END AS section_no, level, coalesce(heading, 'Front matter') AS heading, coalesce(text, '') AS text FROM g)"""


@register(
    f"""{_tree} SELECT q.id, CAST(q.section_no AS INTEGER) AS section_no, CAST(q.level AS INTEGER) AS level, q.heading, (SELECT CAST(max(b.section_no) AS INTEGER) FROM q b WHERE b.id = q.id AND b.section_no < q.section_no AND b.level > 0 AND b.level < q.level) AS parent_no, md5(q.text) AS text FROM q"""
)
def section_tree(s, d):
    """Structured sections of the files."""
    t = spread(table(s, d, "literature_documents").select("id", "content"), "id")
    return sc.section_rows(t, "id").select("id", "section_no", "level", "heading", "parent_no", F.md5("text").alias("text"))


@register()
def raw_sections(s, d):
    """T08."""
    t = spread(table(s, d, "literature_documents").select("id", "content"), "id")
    return sc.raw_section_rows(t, "id", "content").select("id", "section_no", "parent_no", "level", "heading", F.md5("text").alias("text"))


@register()
def page_sections(s, d):
    """T09/F17/M21 over cleaned pages."""
    from ..operators import pages as pg

    return sc.page_section_rows(pg.strip_headers_footers(table(s, d, "extracted_pages"))).select("doc_id", "section_no", "parent_no", "level", "heading", "page_start", "page_end", F.md5("text").alias("text"))


@register()
def section_maps(s, d):
    """T07/M15."""
    t = spread(table(s, d, "literature_documents").select("id", "content"), "id")
    return t.select("id", F.explode(sc.section_map("content", F.lit(None).cast("string")))).select("id", F.col("key").alias("section"), F.md5("value").alias("text"))


@register()
def page_chunks(s, d):
    """T18."""
    return sc.page_chunks(table(s, d, "extracted_pages")).select("doc_id", "chunk_no", "section", "page_start", "page_end", "approx_tokens", "chunk_type", F.md5("text").alias("text"))


@register()
def context_chunks(s, d):
    """File texts packed for a prompt of 4,000 characters."""
    t = table(s, d, "literature_documents").where("content is not null")
    return t.select("id", F.posexplode(sc.pack_context(F.col("content"), sc.context_room(4000, 800))).alias("chunk_no", "chunk"))


_hl = "x"
_conv = f"""CASE WHEN regexp_matches({_hl}, '(?i)^(?:fig|figure)\\.?\\s+\\d+\\.?\\s*.*$') THEN '### Figure ' || regexp_extract({_hl}, '(?i)^(?:fig|figure)\\.?\\s+(\\d+)', 1) || chr(10) || chr(10) || {_strip(f"regexp_extract({_hl}, '(?i)^(?:fig|figure)\\.?\\s+\\d+\\.?\\s*(.*)$', 1)")}
    WHEN regexp_matches({_hl}, '(?i)^table\\s+\\d+\\.?\\s*.*$') THEN '### Table ' || regexp_extract({_hl}, '(?i)^table\\s+(\\d+)', 1) || chr(10) || chr(10) || {_strip(f"regexp_extract({_hl}, '(?i)^table\\s+\\d+\\.?\\s*(.*)$', 1)")}
    WHEN regexp_matches({_hl}, '^(\\d+(?:\\.\\d+){{0,3}})\\.?\\s+.+$') THEN repeat('#', CAST(least(2 + length(regexp_extract({_hl}, '^(\\d+(?:\\.\\d+){{0,3}})\\.?\\s+.+$', 1)) - length(replace(regexp_extract({_hl}, '^(\\d+(?:\\.\\d+){{0,3}})\\.?\\s+.+$', 1), '.', '')), 4) AS BIGINT)) || ' ' || {_hl}
    WHEN trim(regexp_replace(lower({_hl}), '[^a-z0-9 ]+', '', 'g')) IN ({", ".join(f"'{x}'" for x in sc.COMMON_HEADINGS)}) THEN '## ' || {_hl} ELSE {_hl} END"""
_squash = _strip(f"regexp_replace(regexp_replace(regexp_replace({_dehyphen(_dehyphen('t'))}, '[ \\t\\f\\x0B]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@register(
    f"SELECT id, md5({_squash}) AS converted FROM (SELECT id, array_to_string(list_transform(list_transform(regexp_split_to_array(content, '{tx.LINE_END}'), lambda r: {_strip('r')}), lambda x: {_conv}), chr(10)) AS t FROM literature_documents WHERE content IS NOT NULL)"
)
def converted_headings(s, d):
    """T11."""
    t = spread(table(s, d, "literature_documents").where("content is not null").select("id", "content"), "id")
    return t.select("id", F.md5(sc.convert_headings("content")).alias("converted"))


@register(
    f"""SELECT id, CAST(n AS INTEGER) AS page_number, CAST(length({_norm('p')}) AS INTEGER) AS char_count FROM (SELECT id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS n FROM (SELECT id, string_split(content, chr(12)) AS ps FROM literature_documents WHERE content IS NOT NULL)) WHERE {_strip('p')} <> ''"""
)
def page_provenance(s, d):
    """T21/T01."""
    return sc.page_provenance(table(s, d, "literature_documents"), "id")


_stop = "(?:\\n(?:keywords|1\\.?\\s+introduction|introduction|references)\\b|\\z)"
_sci = ", ".join(f"'{x}'" for x in sc.SCIENTIFIC)


@register(
    f"""WITH x AS (SELECT id, content, list_filter(list_transform(regexp_split_to_array(content, '{tx.LINE_END}'), lambda r: {_strip('r')}), lambda r: r <> '') AS ls FROM literature_documents WHERE content IS NOT NULL)
    SELECT id, coalesce(list_filter(ls, lambda r: {_heading('r')} NOT IN ({_sci}) AND NOT regexp_matches(r, '(?i)\\b{tx.DOI_BODY}'))[1], 'Untitled literature record') AS title,
    CASE WHEN contains(ls[2], ',') OR contains(lower(ls[2]), ' and ') THEN regexp_split_to_array(ls[2], '\\s+and\\s+|;\\s*') ELSE {_none} END AS authors,
    regexp_replace(regexp_extract(content, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b', 0), '\\.+$', '') AS doi, length({_squash.replace(_dehyphen(_dehyphen('t')), _dehyphen(_dehyphen(f"regexp_extract(content, '(?is)\\babstract\\b\\s*(.+?){_stop}', 1)")))}) AS abstract_chars FROM x"""
)
def raw_facts(s, d):
    """F03/F49/F50."""
    t = table(s, d, "literature_documents").where("content is not null")
    return t.select("id", tx.title_from_text("content").alias("title"), tx.authors_from_text("content").alias("authors"), tx.doi_strict("content").alias("doi"), F.length(tx.section_after("content", "abstract")).cast("long").alias("abstract_chars"))


@register()
def paper_records(s, d):
    """Records detected in raw texts."""
    t = spread(table(s, d, "literature_documents").where("content is not null").select("id", "content"), "id")
    return sc.paper_record(t, "id", "content").select("id", "title", "doi", "lead_author_year", F.md5("abstract").alias("abstract"))


# --- names, views, small text functions -----------------------------------------------------------


@register()
def safe_names(s, d):
    """F23/F24."""
    t = table(s, d, "paper_metadata")
    return t.select("meta_id", tx.paper_stem("year", "lead_author", "title").alias("stem"), tx.file_stem("pdf_filename").alias("file"))


@register(
    """SELECT id, CASE WHEN coalesce(citation_key, '') = '' THEN 'missing' ELSE 'configured' END AS status, CASE WHEN coalesce(citation_key, '') = '' THEN '' WHEN length(citation_key) > 4 THEN '••••' || right(citation_key, 4) ELSE '••••' END AS masked,
    left(abstract, 100) AS view FROM literature_sources"""
)
def masked_keys(s, d):
    """F26/F40."""
    return table(s, d, "literature_sources").select("id", tx.mask_status("citation_key").alias("status"), tx.mask_secret("citation_key").alias("masked"), tx.prefix("abstract", 100).alias("view"))


@register("SELECT event_type, user_id, '{\"api_key\":\"[REDACTED]\",\"list\":[{\"Token\":\"[REDACTED]\",\"user\":' || user_id || '}]}' AS details, count(*) AS n FROM events GROUP BY 1, 2")
def redacted_events(s, d):
    """Nested details built from the event stream; secrets at any depth are hidden."""
    t = table(s, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    inner = F.array(F.struct(F.lit("t").alias("Token"), F.col("user_id").alias("user")))
    raw = F.to_json(F.struct(F.col("event_type").alias("api_key"), inner.alias("list")))
    return exports.audit_events(t.withColumn("details", raw)).select("event_type", "user_id", F.regexp_replace("details", r"([:,]) ", "$1").alias("details"), "n")


_body = f"nullif({_strip("regexp_replace(content, '^---\\n(?s:.*?)\\n---\\n?', '')")}, '')"


@register(f"SELECT id, left(coalesce({_body}, nullif({_strip('d.filename')}, '')), 700) AS preview, contains(lower(coalesce(content, '')), 'crystal') AS hit FROM literature_documents d")
def previews(s, d):
    """F44/F45."""
    t = table(s, d, "literature_documents")
    return t.select("id", tx.preview("content", F.col("filename")).alias("preview"), tx.searchable(["content"], "crystal").alias("hit"))


_view = "(SELECT * FROM ontology_terms ORDER BY ord LIMIT 80)"


@register(f"SELECT term_id AS source, p AS target, 'subClassOf' AS label FROM (SELECT term_id, unnest(parents) AS p FROM {_view}) WHERE p IN (SELECT term_id FROM {_view})")
def view_edges(s, d):
    """Edges of the view without placeholders."""
    return vocabulary.simplified(*vocabulary.graph(table(s, d, "ontology_terms")))[1]


@register("SELECT DISTINCT s.k AS wanted, t.term_id, t.label FROM (SELECT DISTINCT term_id AS k FROM ontology_terms UNION SELECT iri FROM ontology_terms) s JOIN ontology_terms t ON t.term_id = s.k OR t.iri = s.k")
def term_lookup(s, d):
    """Every id and IRI looked up."""
    t = table(s, d, "ontology_terms")
    return vocabulary.term_by_id(t, t.select(F.explode(F.array("term_id", "iri")).alias("wanted"))).select("wanted", "term_id", "label")


@register()
def searched_terms(s, d):
    """J-09."""
    return vocabulary.search(table(s, d, "ontology_terms"), "crystal growth rate")


@register()
def title_matches(s, d):
    """J-06 with its fuzzy step."""
    t = table(s, d, "paper_metadata").where("title is not null").select(F.col("meta_id").alias("id"), tx.title_key_pipeline("title").alias("key"))
    return linking.title_matches(t, table(s, d, "literature_sources").where("title is not null").select(F.col("id").alias("ord"), tx.title_key_pipeline("title").alias("key")))


_fn, _tw = "lower(trim(coalesce(pdf_filename, '')))", "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), lambda w: length(w) > 2))"
_shared = f"len(list_intersect({_tw.format("coalesce(title, '')")}, {_tw.format("regexp_replace(name, '\\.[^.]*$', '')")}))"


@register(
    f"""WITH f AS (SELECT DISTINCT zotero_item_key AS folder, pdf_path AS path, regexp_extract(pdf_path, '([^/]*)$', 1) AS name FROM paper_metadata WHERE pdf_path <> '' AND zotero_item_key <> ''),
    a AS (SELECT arg_min(title, meta_id) AS title, arg_min(coalesce(pdf_filename, ''), meta_id) AS pdf_filename, zotero_item_key AS key FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM paper_metadata) WHERE zotero_item_key <> '' GROUP BY 3),
    t AS (SELECT key, path, lower(name) AS n, {_shared} AS sh, CASE WHEN {_fn} <> '' AND lower(name) = {_fn} THEN 0 WHEN {_shared} > 0 THEN 2 ELSE 3 END AS tier FROM a JOIN f ON folder = key)
    SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY tier, CASE WHEN tier = 2 THEN -sh ELSE 0 END, n, path) AS INTEGER) AS rank, path FROM t"""
)
def relevant_files(s, d):
    """Stored files of each item key, the likeliest first."""
    m = table(s, d, "paper_metadata").where("zotero_item_key <> ''")
    files = m.where("pdf_path <> ''").select(F.col("zotero_item_key").alias("folder"), F.col("pdf_path").alias("path")).distinct()
    a = m.groupBy(F.col("zotero_item_key").alias("key")).agg(F.min_by(F.coalesce("pdf_filename", F.lit("")), "meta_id").alias("filename"), F.min_by(F.coalesce("title", F.lit("")), "meta_id").alias("title"))
    return vocabulary.relevant_files(files, a.withColumn("path", F.lit("storage:")))


@register(
    """WITH i AS (SELECT DISTINCT zotero_item_key AS key FROM paper_metadata WHERE zotero_item_key <> ''), a AS (SELECT DISTINCT zotero_attachment_key AS key, zotero_item_key AS parent FROM paper_metadata WHERE zotero_attachment_key <> '' AND zotero_item_key <> ''),
    f AS (SELECT zotero_attachment_key AS folder, pdf_path AS path FROM paper_metadata WHERE pdf_path <> '' AND zotero_attachment_key IN (SELECT key FROM a))
    SELECT (SELECT count(*) FROM i) AS items, (SELECT count(*) FROM a) AS attachments, count(DISTINCT folder) AS folders, count(*) AS pdfs FROM f"""
)
def attachment_counts(s, d):
    """J-16."""
    m = table(s, d, "paper_metadata")
    items = m.where("zotero_item_key <> ''").select(F.col("zotero_item_key").alias("key")).distinct()
    att = m.where("zotero_attachment_key <> '' and zotero_item_key <> ''").select(F.col("zotero_attachment_key").alias("key"), F.col("zotero_item_key").alias("parent")).distinct()
    return readers.attachment_counts(items, att, m.where("pdf_path <> ''").select(F.col("zotero_attachment_key").alias("folder"), F.col("pdf_path").alias("path")))


@register("SELECT count(DISTINCT folder) AS folders, count(DISTINCT CASE WHEN pdf THEN folder END) AS folders_with_pdf, count(*) FILTER (WHERE pdf) AS pdfs FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(path) LIKE '%.pdf' AS pdf FROM literature_documents)")
def storage_summary(s, d):
    """A06."""
    return readers.storage_summary(table(s, d, "literature_documents")).drop("first")


# --- pages ----------------------------------------------------------------------------------------


def _page_blocks(s, d):
    """Lines of pages as blocks of a two-column page: even lines left, odd ones right, every seventh across."""
    ls = table(s, d, "extracted_pages").where("text is not null").select(F.col("page_id").cast("string").alias("path"), "page_number", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    x0 = F.when(F.col("n") % 7 == 0, 0.0).when(F.col("n") % 2 == 0, 10.0).otherwise(310.0)
    x1 = F.when(F.col("n") % 7 == 0, 600.0).otherwise(x0 + 280)
    return ls.select("path", "page_number", F.lit(600.0).alias("page_width"), x0.alias("x0"), F.col("n").cast("double").alias("y0"), x1.alias("x1"), "text")


_ordered = _strip(f"regexp_replace(regexp_replace(regexp_replace({_dehyphen(_dehyphen('nfc_normalize(t)'))}, '[ \\t\\f\\x0B]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@register(
    f"""WITH l AS (SELECT page_id, page_number, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM extracted_pages WHERE text IS NOT NULL),
    c AS (SELECT *, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE 2 END AS half FROM l WHERE {_strip('x')} <> ''), b AS (SELECT *, bool_or(half = 1) OVER (PARTITION BY page_id) AND bool_or(half = 2) OVER (PARTITION BY page_id) AS two FROM c)
    SELECT CAST(page_id AS VARCHAR) AS path, page_number, md5({_ordered}) AS text FROM (SELECT page_id, page_number, string_agg(regexp_replace(x, '\\r\\n?', chr(10), 'g'), chr(10) ORDER BY CASE WHEN half = 2 AND NOT two THEN 1 ELSE half END, n) AS t FROM b GROUP BY 1, 2)"""
)
def reading_order(s, d):
    """S14."""
    return readers.reading_order(_page_blocks(s, d)).select("path", "page_number", F.md5("text").alias("text"))


@register("SELECT doc_id, count(*) AS pages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, CASE WHEN sum(coalesce(length(text), 0)) >= 500 THEN 'complete' ELSE 'partial_or_empty' END AS status FROM extracted_pages GROUP BY 1")
def extraction_status(s, d):
    """S15/A07."""
    return readers.extraction_status(table(s, d, "extracted_pages").withColumn("error", F.lit(None).cast("string")), "doc_id")


_cp = _strip(f"regexp_replace(regexp_replace({_dehyphen(f'replace(regexp_replace(text, {chr(39)}\\r\\n?{chr(39)}, chr(10), {chr(39)}g{chr(39)}), chr(173), {chr(39)}{chr(39)})')}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@register(f"SELECT page_id, count(*) AS lines, md5(string_agg(x, chr(10) ORDER BY n)) AS text FROM (SELECT page_id, {_strip('r')} AS x, n FROM (SELECT page_id, unnest(ls) AS r, unnest(range(len(ls))) AS n FROM (SELECT page_id, regexp_split_to_array({_cp}, '{tx.LINE_END}') AS ls FROM extracted_pages WHERE text IS NOT NULL))) WHERE x <> '' GROUP BY 1")
def page_line_rows(s, d):
    """S16."""
    ls = readers.page_lines(table(s, d, "extracted_pages"), "page_id").groupBy("page_id")
    return ls.agg(F.count(F.lit(1)).alias("lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("text"))


# --- ontology files: the term list written in each format and read back ----------------------------

_listed = f"list_filter(list_transform(coalesce(synonyms, {_none}), lambda x: {_clean('x')}), lambda x: x IS NOT NULL)"


def _written(s, d, line):
    t = table(s, d, "ontology_terms").where("term_id is not null and label is not null")
    return t.select(F.col("term_id").alias("path"), line.alias("value"))


@register(f"SELECT term_id, {_strip('label')} AS label, {_clean('definition')} AS definition, CAST(len({_listed}) AS INTEGER) AS synonyms, CAST(len(parents) AS INTEGER) AS parents FROM ontology_terms WHERE label IS NOT NULL")
def obo_round(s, d):
    """S23."""
    each = lambda tag, c, left, right: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{tag}: {left}"), x, F.lit(f"{right}\n"))), "")
    said = F.filter("synonyms", lambda x: tx.clean_string(x).isNotNull())
    line = F.concat(
        F.lit("format-version: 1.2\n\n[Term]\nid: "), "term_id", F.lit("\nname: "), "label", F.lit("\n"), F.coalesce(F.concat(F.lit("def: "), tx.clean_string("definition"), F.lit("\n")), F.lit("")),
        each("synonym", said, '"', '" EXACT []'), each("is_a", F.col("parents"), "", " ! parent"), F.lit("\n[Typedef]\nid: part_of\nname: part of\n"),
    )
    return readers.obo_terms(_written(s, d, line)).select("term_id", "label", "definition", F.size("synonyms").alias("synonyms"), F.size("parents").alias("parents"))


@register(f"SELECT term_id, {_strip('label')} AS label, {_clean('definition')} AS definition, CAST(len({_listed}) AS INTEGER) AS synonyms, CAST(len(parents) AS INTEGER) AS parents FROM ontology_terms WHERE {_clean('label')} IS NOT NULL AND NOT starts_with({_strip('label')}, 'A ')")
def tsv_round(s, d):
    """S24."""
    said = F.array_join(F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: tx.clean_string(x).isNotNull()), ";")
    row = F.concat_ws("\t", "term_id", "label", F.coalesce("definition", F.lit("")), said, F.array_join("parents", "|"))
    line = F.concat(F.lit("ID\tLABEL\tdefinition\tsynonyms\tparent\nID\tA rdfs:label\tA IAO:0000115\tA oboInOwl:hasExactSynonym\tSC %\n"), row, F.lit("\n"))
    return readers.tsv_terms(_written(s, d, line)).select("term_id", "label", "definition", F.size("synonyms").alias("synonyms"), F.size("parents").alias("parents"))


@register(f"SELECT 'x' || ord AS term_id, label, definition, CAST(len(list_filter(coalesce(synonyms, {_none}), lambda x: x IS NOT NULL)) AS INTEGER) AS synonyms FROM ontology_terms WHERE label <> ''")
def triples_round(s, d):
    """N-Triples."""
    t = table(s, d, "ontology_terms").where("label <> ''")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('" .\n'))
    me = F.concat(F.lit("<http://x.example/x"), F.col("ord").cast("string"), F.lit("> "))
    said = lambda p, c: F.concat(me, F.lit(f"<http://p.example/{p}> "), quoted(c))
    syn = F.array_join(F.transform(F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: said("hasExactSynonym", x)), "")
    line = F.concat(said("rdf#label", F.col("label")), F.coalesce(said("IAO_0000115", F.col("definition")), F.lit("")), syn)
    return readers.triple_terms(readers.triples(t.select("term_id", line.alias("value")))).select("term_id", "label", "definition", F.size("synonyms").alias("synonyms"))


# --- stored rows ----------------------------------------------------------------------------------

_states = ["new", "in_review", "needs_review"]


@register("SELECT id, candidate_id FROM candidate_terms WHERE review_status IN ('new', 'in_review', 'needs_review')")
def queued_rows(s, d):
    """P01/P02/O01 with the states as parameter."""
    return review.in_states(table(s, d, "candidate_terms"), "review_status", _states)[0].select("id", "candidate_id")


@register("SELECT candidate_id, label, 'approved' AS status FROM candidate_terms WHERE review_status = 'approved'")
def exported_rows(s, d):
    """K03/P03."""
    return exports.export(table(s, d, "candidate_terms"), ["approved"], "candidates").select("candidate_id", "label", "status")


@register("SELECT id, CASE WHEN proposed_definition IS NULL THEN label || ' (revised)' ELSE label END AS label, CAST(NULL AS VARCHAR) AS proposed_parent, confidence_score FROM candidate_terms")
def patched_rows(s, d):
    """Two patches per row; a NULL clears the parent, and is ignored for the score."""
    t = table(s, d, "candidate_terms")
    one = t.select("id", F.lit(1).alias("ord"), F.create_map(F.lit("label"), F.when(F.col("proposed_definition").isNull(), F.concat("label", F.lit(" (revised)"))), F.lit("confidence_score"), F.lit(None).cast("string")).alias("fields"))
    two = t.select("id", F.lit(2).alias("ord"), F.create_map(F.lit("proposed_parent"), F.lit(None).cast("string")).alias("fields"))
    return review.patched(t, one.unionByName(two), "id", nullable=("proposed_parent",)).select("id", "label", "proposed_parent", "confidence_score")


@register("SELECT id, CASE review_status WHEN 'approved' THEN CASE WHEN confidence_score >= 0.5 THEN 'sent' ELSE 'built' END WHEN 'new' THEN 'new' ELSE review_status END AS review_status FROM candidate_terms")
def moved_rows(s, d):
    """Outcomes of two stages moved through a given table of states."""
    t = table(s, d, "candidate_terms")
    outcomes = t.select("id", F.lit(1).alias("seq"), F.lit("built").alias("outcome")).unionByName(t.where("confidence_score >= 0.5").select("id", F.lit(2).alias("seq"), F.lit("sent").alias("outcome")))
    return review.transitioned(t, outcomes, "id", "review_status", {("approved", "built"): "built", ("built", "sent"): "sent"}).select("id", "review_status")


@register("SELECT coalesce(k1, k2) AS key, CASE WHEN k1 IS NOT NULL THEN v1 ELSE v2 END AS value FROM (SELECT lang AS k1, CAST(min(doc_id) AS VARCHAR) AS v1 FROM documents WHERE lang IS NOT NULL GROUP BY 1) FULL JOIN (SELECT DISTINCT source AS k2, 'default' AS v2 FROM documents WHERE source IS NOT NULL) ON k1 = k2")
def merged_settings(s, d):
    """M06/U02/V05."""
    t = table(s, d, "documents")
    stored = t.where("lang is not null").groupBy(F.col("lang").alias("key")).agg(F.lit("old").alias("value"))
    changes = t.where("lang is not null").groupBy(F.col("lang").alias("key")).agg(F.min("doc_id").cast("string").alias("value")).withColumn("ord", F.lit(1))
    defaults = t.where("source is not null").select(F.col("source").alias("key"), F.lit("default").alias("value")).distinct()
    return papers.settings(papers.put_settings(stored, changes), defaults)


@register("SELECT count(*) AS total, count(*) FILTER (WHERE review_status = 'approved') AS approved, count(*) FILTER (WHERE proposed_definition IS NULL) AS undefined FROM candidate_terms")
def row_counts(s, d):
    """A01."""
    return review.counted(table(s, d, "candidate_terms"), approved=F.col("review_status") == "approved", undefined=F.col("proposed_definition").isNull())
