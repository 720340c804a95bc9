"""Registry of the engine's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments as sg
from ..functions import similarity as sim
from ..functions import structured as st
from ..functions import text as tx
from ..operators import exports, linking, pages, vocabulary
from ..session import spread, table
from .registry import register

WS = tx.WS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _doi(x: str) -> str:
    x = f"lower({_strip(x)})"
    x = f"regexp_replace({x}, '^https?://{tx.DOI_HOSTS}/', '')"
    x = f"regexp_replace({x}, '^doi:\\s*', '')"
    x = f"regexp_replace({x}, '{WS}+', '', 'g')"
    return f"nullif(regexp_replace({x}, '[.,;:)\\]}}]+$', ''), '')"


def _title(x: str) -> str:
    return _collapse(f"regexp_replace(lower({x}), '{tx.PUNCTUATION}', ' ', 'g')")


def _unix(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


def _dehyphen(x: str) -> str:
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}\\p{{M}}_])-\\n([\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\2', 'g')"


def _heading(x: str) -> str:
    x = f"regexp_replace(lower({_strip(x)}), '^\\s*\\d+(?:\\.\\d+)*\\.?\\s+', '')"
    return f"regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return f"greatest(1, CAST(floor(len({_words(f"coalesce({x}, '')")}) / 0.75) AS INTEGER))"


def _chunk_type(x: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains(lower({x}), '{n}')" for n in needles)} THEN '{kind}'" for kind, needles in tx.CHUNK_TYPES)
    return f"CASE {cases} ELSE 'other' END"


# --- identifiers and keys -----------------------------------------------------------------------


@register(f"SELECT id, {_doi('doi')} AS doi_key FROM literature_sources")
def doi_keys(s, d):
    return table(s, d, "literature_sources").select("id", tx.normalize_doi("doi").alias("doi_key"))


_found = f"regexp_extract_all(coalesce(content, ''), '(?i)(?:https?://{tx.DOI_HOSTS}/|doi:\\s*)?({tx.DOI_BODY})', 1)"


@register(f"SELECT DISTINCT id, k AS doi_key FROM (SELECT id, {_doi('x')} AS k FROM (SELECT id, unnest({_found}) AS x FROM literature_documents)) WHERE k IS NOT NULL")
def dois_in_files(s, d):
    return table(s, d, "literature_documents").select("id", F.explode(tx.all_dois("content")).alias("doi_key"))


@register(f"SELECT id, nullif(regexp_replace(regexp_extract(content, '(?i)\\b{tx.DOI_BODY}', 0), '\\.+$', ''), '') AS doi FROM literature_documents")
def first_doi_in_files(s, d):
    return table(s, d, "literature_documents").select("id", tx.first_doi("content").alias("doi"))


_merge = _strip("split_part(" + _strip("title") + ", '|', 1)")
_merge = f"lower(regexp_replace(regexp_replace({_merge}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g'))"
_merge = f"replace(replace(replace(replace(replace(translate({_merge}, '–—', '--'), 'β', 'beta'), 'α', 'alpha'), 'γ', 'gamma'), 'δ', 'delta'), 'μ', 'mu')"
_merge = f"regexp_replace({_merge}, '[/:;,.()\\[\\]{{}}\"''‘’“”]', '', 'g')"
_merge = _collapse(f"regexp_replace({_merge}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\x{{00A0}}-]', ' ', 'g')")


@register(f"SELECT id, {_title('title')} AS import_key, {_merge} AS merge_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS pipeline_key FROM literature_sources")
def title_keys(s, d):
    return table(s, d, "literature_sources").select("id", tx.title_key_import("title").alias("import_key"), tx.title_key_merge("title").alias("merge_key"), tx.title_key_pipeline("title").alias("pipeline_key"))


@register(
    f"SELECT id, {_collapse('lower(label)')} AS label_key, 'CAND:' || substr(sha1(CAST(document_id AS VARCHAR) || ':' || {_collapse('lower(label)')}), 1, 12) AS candidate_key FROM candidate_terms WHERE label IS NOT NULL AND document_id IS NOT NULL"
)
def label_keys(s, d):
    t = table(s, d, "candidate_terms").where("label is not null and document_id is not null")
    return t.select("id", tx.label_key("label").alias("label_key"), tx.candidate_id("document_id", "label").alias("candidate_key"))


_num = f"regexp_extract({_strip('heading')}, '^(\\d+(?:\\.\\d+){{0,3}})\\.?\\s+(.+)$', 1)"
_sw = ", ".join(f"'{w}'" for w in tx.SECTION_WORDS)


@register(
    f"""SELECT section_id, {_heading('heading')} AS heading_key, {_chunk_type('heading')} AS chunk_type,
    CASE WHEN {_num} <> '' THEN least(2 + length({_num}) - length(replace({_num}, '.', '')), 4)
         WHEN regexp_replace(lower({_strip('heading')}), '[^a-z0-9 ]+', '', 'g') IN ({_sw}) THEN 2
         WHEN regexp_matches({_strip('heading')}, '(?i)^(?:figure|fig)\\.?\\s+\\d+') OR regexp_matches({_strip('heading')}, '(?i)^table\\s+\\d+') THEN 3 END AS heading_level
    FROM sections_flat"""
)
def heading_keys(s, d):
    return table(s, d, "sections_flat").select("section_id", tx.heading_key("heading").alias("heading_key"), tx.chunk_type("heading").alias("chunk_type"), tx.heading_level("heading").alias("heading_level"))


_k = "coalesce(provider_item_key, '')"


@register(
    f"""SELECT id, CASE WHEN regexp_matches({_k}, '^[A-Za-z0-9]{{6,14}}$') THEN 'zotero-' || provider_item_key
      WHEN length(normalized_doi) > 0 THEN 'doi-' || substr(sha1(lower(normalized_doi)), 1, 12)
      ELSE 'paper-' || substr(sha1(lower(coalesce(nullif(title, ''), 'unknown'))), 1, 12) END AS paper_id,
    coalesce(nullif(substr(lower(regexp_replace(regexp_replace(seed, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 90), ''), 'paper') || '-' || substr(sha1(lower(seed)), 1, 8) || '.md' AS file
    FROM (SELECT *, coalesce('doi-' || nullif(normalized_doi, ''), 'id-' || nullif(citation_key, ''), nullif(title, ''), '') AS seed FROM literature_sources)"""
)
def paper_ids(s, d):
    return table(s, d, "literature_sources").select("id", tx.paper_id("provider_item_key", "normalized_doi", "title").alias("paper_id"), tx.paper_filename("normalized_doi", "citation_key", "title").alias("file"))


@register(
    """SELECT id, CASE WHEN p IS NULL THEN 'zotero://select/library/items/' || k END AS uri, p AS problem FROM (
      SELECT id, provider_item_key AS k, CASE WHEN provider_item_key IS NULL OR provider_item_key = '' THEN 'missing_key'
        WHEN NOT regexp_matches(provider_item_key, '^[A-Za-z0-9]{6,14}$') THEN 'malformed_key'
        WHEN count(*) OVER (PARTITION BY provider_item_key) > 1 THEN 'duplicate_key' END AS p FROM literature_sources)"""
)
def select_links(s, d):
    src = table(s, d, "literature_sources")
    n = src.where("provider_item_key is not null").groupBy("provider_item_key").agg(F.count(F.lit(1)).alias("copies"))
    j = src.select("id", "provider_item_key").join(n, "provider_item_key", "left")
    return j.select("id", tx.select_uri("provider_item_key", F.col("copies"), F.lit(None).cast("long")).alias("u")).select("id", "u.uri", "u.problem")


@register(
    """SELECT id, nullif(regexp_extract(year, '\\d{4}', 0), '') AS year_any, nullif(regexp_extract(year, '(?:19|20)\\d{2}', 0), '') AS year_century,
    nullif(regexp_extract(year, '\\b(?:19|20)\\d{2}\\b', 0), '') AS year_word FROM literature_sources"""
)
def years(s, d):
    return table(s, d, "literature_sources").select("id", tx.year_any("year").alias("year_any"), tx.year_century("year").alias("year_century"), tx.year_word("year").alias("year_word"))


_names = "list_filter(list_transform(creators, lambda x: trim(concat_ws(' ', x.given, x.family))), lambda n: n <> '')"


@register(f"SELECT id, len({_names}) AS authors, list_extract(regexp_split_to_array(split_part({_names}[1], ',', 1), '\\s+'), -1) AS lead_author FROM literature_sources")
def authors(s, d):
    return table(s, d, "literature_sources").select("id", F.when(F.col("creators").isNotNull(), F.size(tx.creator_names("creators"))).alias("authors"), tx.lead_author("creators").alias("lead_author"))


@register(f"SELECT tag, count(*) AS n FROM (SELECT {_strip('t')} AS tag FROM (SELECT unnest(tags) AS t FROM literature_sources)) WHERE tag <> '' GROUP BY tag")
def tags(s, d):
    return table(s, d, "literature_sources").select(F.explode(tx.string_list("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@register(
    """SELECT suffix, CASE lower(suffix) WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown'
    WHEN '.tsv' THEN 'text/tab-separated-values' WHEN '.csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS mime, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes
    FROM literature_documents GROUP BY suffix"""
)
def mime_types(s, d):
    t = table(s, d, "literature_documents").groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return t.select("suffix", tx.mime_type("suffix").alias("mime"), "files", "bytes")


_stem = "regexp_replace(d.filename, '\\.[^.]*$', '')"
_parts = f"regexp_split_to_array({_stem}, '\\s+-\\s+')"


@register(
    f"SELECT id, CASE WHEN len({_parts}) >= 3 THEN {_parts}[-1] ELSE {_stem} END AS name_title, coalesce(nullif(regexp_extract(content, '(?m)^title:\\s*\"?(.*?)\"?\\s*$', 1), ''), nullif(regexp_extract(content, '(?m)^#\\s+(.+?)\\s*$', 1), ''), {_stem}) AS text_title FROM literature_documents d"
)
def file_titles(s, d):
    t = table(s, d, "literature_documents")
    return t.select("id", tx.title_from_filename("filename").alias("name_title"), tx.title_from_markdown("content", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("text_title"))


# --- cleaning -------------------------------------------------------------------------------------

_b = _strip(f"regexp_replace(regexp_replace({_unix('text')}, '[ \\t\\f\\x0B]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_c = _strip(f"regexp_replace(regexp_replace({_dehyphen(f'replace({_unix('text')}, chr(173), {chr(39)}{chr(39)})')}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@register(f"SELECT page_id, md5(nullif({_b}, '')) AS plain, md5({_c}) AS joined FROM extracted_pages")
def page_whitespace(s, d):
    return table(s, d, "extracted_pages").select("page_id", F.md5(tx.whitespace_b("text")).alias("plain"), F.md5(tx.clean_pdf_text("text")).alias("joined"))


@register(
    f"""WITH l AS (SELECT id, unnest(string_split({_unix('content')}, chr(10))) AS raw, unnest(range(len(string_split({_unix('content')}, chr(10))))) AS pos FROM literature_documents WHERE content IS NOT NULL),
    t AS (SELECT id, pos, {_strip('raw')} AS x FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY id, x) AS c FROM t),
    k AS (SELECT * FROM n WHERE x = '' OR (NOT (c > 1 AND length(x) < 120) AND NOT regexp_matches(x, '^(?i:(?:page\\s*)?\\d+)$') AND NOT regexp_matches(x, '(?i)copyright|all rights reserved|downloaded from|publisher'))),
    j AS (SELECT id, string_agg(x, chr(10) ORDER BY pos) AS m FROM k GROUP BY id)
    SELECT id, md5({_strip(f"regexp_replace(regexp_replace({_dehyphen('m')}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS cleaned FROM j"""
)
def clean_files(s, d):
    t = spread(table(s, d, "literature_documents").where("content is not null").select("id", "content"), "id")
    return t.select("id", F.md5(tx.clean_extracted("content")).alias("cleaned")).where("cleaned is not null")


@register(f"SELECT id, md5({_strip(f"regexp_replace(content, '(?im)^\\s*(?:references|bibliography|literature cited)\\s*$(?s:.*)', '')")}) AS body, regexp_matches(coalesce(content, ''), '(?im)^references\\s*$') AS has_references FROM literature_documents")
def body_text(s, d):
    return table(s, d, "literature_documents").select("id", F.md5(tx.strip_references("content")).alias("body"), tx.has_references("content").alias("has_references"))


_lines = f"list_transform(regexp_split_to_array(text, '{tx.LINE_END}'), lambda x: {_strip('x')})"


_pages_head = f"""WITH p AS (SELECT doc_id, page_id, page_number, text, {_lines} AS ls FROM extracted_pages WHERE text IS NOT NULL),
    f AS (SELECT *, list_filter(ls, lambda x: x <> '') AS nb FROM p),
    e AS (SELECT DISTINCT doc_id, page_id, lower(x) AS line FROM (SELECT doc_id, page_id, unnest(list_concat(nb[1:4], nb[greatest(len(nb) - 3, 1):len(nb)])) AS x FROM f) WHERE length(x) <= 120),
    c AS (SELECT doc_id, line, count(*) AS n FROM e GROUP BY 1, 2), z AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1),
    r AS (SELECT c.doc_id, list(line) AS rep FROM c JOIN z USING (doc_id) WHERE n >= 2 AND n >= greatest(2, pages // 2) GROUP BY 1)"""


@register(
    _pages_head + r""" SELECT p.doc_id, p.page_id, len(list_filter(p.ls, lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:(?:page\s*)?\d+)$') AND NOT coalesce(list_contains(r.rep, lower(x)), false))) AS kept_lines
    FROM p LEFT JOIN r USING (doc_id)""".replace("\\\\", "\\")
)
def header_footer(s, d):
    return pages.kept_lines(table(s, d, "extracted_pages"))


_kept = "list_filter(regexp_split_to_array(p.text, '" + tx.LINE_END + "'), lambda x: NOT regexp_matches(" + _strip("x") + ", '^(?i:(?:page\\s*)?\\d+)$') AND NOT coalesce(list_contains(r.rep, lower(" + _strip("x") + ")), false))"
_squashed = _strip(f"regexp_replace(regexp_replace(regexp_replace({_dehyphen(_dehyphen('nfc_normalize(t)'))}, '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@register(_pages_head + f" SELECT doc_id, page_id, page_number, {_squashed} AS text FROM (SELECT p.doc_id, p.page_id, p.page_number, array_to_string({_kept}, chr(10)) AS t FROM p LEFT JOIN r USING (doc_id))")
def cleaned_pages(s, d):
    return pages.strip_headers_footers(table(s, d, "extracted_pages"))


# --- segmentation ---------------------------------------------------------------------------------


@register(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{4,}}')) AS word, unnest(range(len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{4,}}')))) AS pos FROM documents),
    n AS (SELECT doc_id, lower(word) AS k, count(*) AS n, arg_min(word, pos) AS term FROM w WHERE lower(word) NOT IN ({", ".join(f"'{x}'" for x in sg.NO_TERMS)}) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS INTEGER) AS rank FROM n)
    SELECT doc_id, rank, term, n FROM r WHERE rank <= 10"""
)
def key_terms_top10(s, d):
    return sg.key_terms(table(s, d, "documents"), "doc_id", "text")


@register(f"SELECT doc_id, {_tokens('text')} AS by_words, greatest(1, CAST(round_even(coalesce(length(text), 0) / 4.0, 0) AS INTEGER)) AS by_chars FROM documents")
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", tx.tokens_by_words("text").alias("by_words"), tx.tokens_by_chars("text").alias("by_chars"))


@register(
    f"SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: length(x) BETWEEN 20 AND 65)) / greatest(len(ls), 1) > 0.55 THEN 'two_column' ELSE 'single_column' END AS layout, CASE WHEN len(ls) = 0 THEN 'unknown' WHEN len(list_filter(ls, lambda x: length(x) BETWEEN 20 AND 65)) / len(ls) > 0.65 THEN 'two-column' WHEN len(list_filter(ls, lambda x: length(x) BETWEEN 20 AND 65)) / len(ls) < 0.35 THEN 'single-column' ELSE 'mixed' END AS by_lines FROM (SELECT doc_id, list_filter({_lines}, lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL)"
)
def layouts(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", tx.layout_by_share("text").alias("layout"), tx.layout_by_lines("text").alias("by_lines"))


_cues = " OR ".join(f"contains(lower(claim), '{c}')" for c in sg.CLAIM_CUES)


@register(
    f"""WITH x AS (SELECT *, {_chunk_type('heading')} AS kind, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM sections_flat),
    y AS (SELECT paper_key, section_no, section_id, heading, page_start, page_end, kind, unnest(p) AS raw, unnest(range(len(p))) AS k FROM x WHERE kind NOT IN ('reference', 'declaration', 'table', 'figure_caption')),
    z AS (SELECT *, {_strip('raw')} AS claim FROM y), w AS (SELECT * FROM z WHERE len({_words('claim')}) >= 8 AND ({_cues})),
    n AS (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY section_no, k, claim) AS n FROM w)
    SELECT paper_key, count(*) AS claims, CAST(count(*) FILTER (WHERE kind IN ('method', 'result', 'conclusion')) AS BIGINT) AS typed FROM n GROUP BY paper_key"""
)
def claim_counts(s, d):
    c = sg.claims(table(s, d, "sections_flat"), 2**31 - 1)
    return c.groupBy("paper_key").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("type") != "background").alias("typed"))


@register()
def claims(s, d):
    return sg.claims(table(s, d, "sections_flat"))


_fw = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z-]{{3,}}'), lambda w: NOT list_contains([{', '.join(f"'{x}'" for x in sg.NO_PHRASES)}], w))"


@register(
    f"""WITH w AS (SELECT doc_id, {_fw} AS ws FROM documents), p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS phrase, unnest(range(1, len(ws))) AS pos FROM w),
    f AS (SELECT doc_id, phrase, min(pos) AS pos FROM p GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS rank FROM f)
    SELECT doc_id, rank, phrase FROM r WHERE rank < 5"""
)
def candidate_phrases(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(sg.candidate_phrases(F.col("text"))).alias("rank", "phrase"))


@register()
def generated_candidates(s, d):
    return sg.generated_candidates(table(s, d, "documents"), "doc_id", "text")


@register()
def chunks_4000(s, d):
    return sg.section_chunks(table(s, d, "literature_documents"), "id", "content")


@register()
def retrieval_chunks(s, d):
    return sg.retrieval_chunks(table(s, d, "sections_flat"))


@register()
def section_tree(s, d):
    return sg.sections(table(s, d, "literature_documents"), "id")


@register(
    f"""WITH l AS (SELECT id, unnest(regexp_split_to_array(content, '{tx.LINE_END}')) AS raw FROM literature_documents) SELECT id, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT id, {_strip('raw')} AS x FROM l) WHERE x <> '' GROUP BY id"""
)
def file_lines(s, d):
    return sg.line_rows(table(s, d, "literature_documents"), "id", "content").groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


# --- JSON and front matter ------------------------------------------------------------------------

_js = lambda p: _strip(f"json_extract_string(raw, '$.{p}')")


@register(
    f"""SELECT raw_id, nullif({_js('title')}, '') AS title, nullif({_js('type')}, '') AS item_type, {_doi("nullif(" + _js('DOI') + ", '')")} AS doi,
    json_extract_string(raw, '$.issued."date-parts"[0][0]') AS year, CAST(coalesce(json_array_length(raw, '$.author'), -1) AS INTEGER) AS creators
    FROM csl_items WHERE json_valid(raw) AND nullif({_js('title')}, '') IS NOT NULL"""
)
def csl_records(s, d):
    return st.csl_projection(table(s, d, "csl_items"), "raw_id").select("raw_id", "title", "item_type", "doi", "year", F.coalesce(F.size("creators"), F.lit(-1)).alias("creators"))


@register(
    f"SELECT CASE WHEN NOT json_valid(raw) THEN 'malformed' WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' WHEN nullif({_js('title')}, '') IS NULL THEN 'no_title' ELSE 'record' END AS outcome, count(*) AS n FROM csl_items GROUP BY 1"
)
def csl_outcomes(s, d):
    return st.skipped_items(table(s, d, "csl_items"))


_fm = "regexp_extract(content, '(?s)^---\\n(.*?)\\n---', 1)"


@register(
    f"""SELECT id, nullif(regexp_replace({_strip(f"regexp_extract({_fm}, '(?m)^title:[ \\t]*(.*)$', 1)")}, '^"(.*)"$', '\\1'), '') AS title,
    nullif(regexp_replace({_strip(f"regexp_extract({_fm}, '(?m)^doi:[ \\t]*(.*)$', 1)")}, '^"(.*)"$', '\\1'), '') AS doi FROM literature_documents WHERE starts_with(content, '---' || chr(10)) AND {_fm} <> ''"""
)
def front_matter(s, d):
    t = table(s, d, "literature_documents").withColumn("b", st.front_matter(F.col("content"))).where("b is not null")
    return t.select("id", st.front_matter_value(F.col("b"), "title").alias("title"), st.front_matter_value(F.col("b"), "doi").alias("doi"))


@register(f"SELECT id, length({_strip("regexp_extract(content, '(?ims)^## References[ \\t]*\\n(.*?)(?:^## |\\z)', 1)")}) AS reference_chars FROM literature_documents WHERE content IS NOT NULL")
def reference_sections(s, d):
    return table(s, d, "literature_documents").where("content is not null").select("id", F.length(st.markdown_section(F.col("content"), "References")).alias("reference_chars"))


_blank = lambda x: f"coalesce({_strip(x)}, '') = ''"


@register(
    f"""SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN {_blank('label')} THEN 'blank_label' END,
      CASE WHEN confidence_score IS NULL OR NOT confidence_score BETWEEN 0 AND 1 THEN 'score_range' END, CASE WHEN coalesce(len(evidence), 0) <= 0 THEN 'no_evidence' END,
      CASE WHEN len(list_filter(evidence, lambda e: {_blank('e.quoted_text')})) > 0 THEN 'blank_quote' END,
      CASE WHEN len(list_filter(evidence, lambda e: NOT coalesce(list_contains(['direct', 'inferred', 'contextual'], e.direct_or_inferred), false))) > 0 THEN 'bad_mode' END], lambda x: x IS NOT NULL)) AS v FROM candidate_terms) GROUP BY v"""
)
def contract_violations(s, d):
    t = table(s, d, "candidate_terms").select(F.to_json(F.struct("label", "proposed_definition", "synonyms", "proposed_parent", "confidence_score", "evidence")).alias("raw"))
    c = t.select(F.from_json("raw", st.CANDIDATE).alias("c"))
    return c.select(F.explode(st.candidate_violations(F.col("c"))).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


# --- linking, upserts, dedupe ---------------------------------------------------------------------

_name = "lower(d.filename)"


@register(
    f"""WITH dd AS (SELECT id, source_id, {_name} AS name, {_title('d.filename')} AS nk, {_title("coalesce(content, '')")} AS tk, {_found} AS raw FROM literature_documents d),
    dx AS (SELECT DISTINCT id, {_doi('x')} AS k FROM (SELECT id, unnest(raw) AS x FROM dd)),
    ss AS (SELECT id AS sid, nullif(lower({_strip('citation_key')}), '') AS ck, normalized_doi, normalized_title AS t FROM literature_sources),
    h AS (SELECT dd.id, sid FROM dd JOIN dx USING (id) JOIN ss ON normalized_doi = k WHERE source_id IS NULL
      UNION SELECT id, sid FROM dd JOIN ss ON contains(name, ck) WHERE source_id IS NULL AND ck IS NOT NULL
      UNION SELECT id, sid FROM dd JOIN ss ON t <> '' AND (contains(nk, t) OR contains(tk, t)) WHERE source_id IS NULL),
    n AS (SELECT id, count(DISTINCT sid) AS n, min(sid) AS sid FROM h GROUP BY id)
    SELECT dd.id, CASE WHEN source_id IS NOT NULL THEN source_id WHEN n = 1 THEN sid END AS source_id,
    CASE WHEN source_id IS NOT NULL THEN 'skipped' WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'skipped' END AS outcome FROM dd LEFT JOIN n USING (id)"""
)
def link_documents(s, d):
    return linking.link_documents(table(s, d, "literature_documents"), table(s, d, "literature_sources"))


@register(
    """WITH k AS (SELECT 'provider_item_key' AS field, provider_item_key AS key FROM literature_sources UNION ALL SELECT 'normalized_doi', normalized_doi FROM literature_sources UNION ALL SELECT 'normalized_title', normalized_title FROM literature_sources)
    SELECT field, key, count(*) AS n FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2 HAVING count(*) > 1"""
)
def duplicate_keys(s, d):
    src = table(s, d, "literature_sources")
    parts = [linking.duplicate_keys(src, c).select(F.lit(c).alias("field"), "key", "n") for c in ("provider_item_key", "normalized_doi", "normalized_title")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _incoming(s: SparkSession, d: str) -> DataFrame:
    return st.csl_projection(table(s, d, "csl_items"), "raw_id").withColumnRenamed("raw_id", "row_id")


_inc = f"""inc AS (SELECT raw_id, nullif({_js('title')}, '') AS title, nullif({_js('id')}, '') AS ik, nullif({_js('citationKey')}, '') AS ck, {_doi("nullif(" + _js('DOI') + ", '')")} AS doi FROM csl_items WHERE json_valid(raw) AND nullif({_js('title')}, '') IS NOT NULL),
    m AS (SELECT raw_id, coalesce((SELECT min(id) FROM literature_sources s WHERE s.provider = 'zotero' AND s.provider_item_key = ik), (SELECT min(id) FROM literature_sources s WHERE s.provider = 'zotero' AND s.citation_key = ck),
      (SELECT min(id) FROM literature_sources s WHERE s.normalized_doi = inc.doi), (SELECT min(id) FROM literature_sources s WHERE s.provider = 'zotero' AND s.normalized_title = {_title('inc.title')} AND s.normalized_title <> '')) AS matched_id FROM inc)"""


@register(f"WITH {_inc} SELECT raw_id AS row_id, matched_id FROM m")
def upsert_matches(s, d):
    return linking.cascade_match(_incoming(s, d), table(s, d, "literature_sources"))


@register(
    f"""WITH {_inc}, u AS (SELECT DISTINCT matched_id FROM m WHERE matched_id IS NOT NULL)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN u.matched_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM literature_sources LEFT JOIN u ON id = u.matched_id UNION ALL SELECT 'inserted' FROM m WHERE matched_id IS NULL) GROUP BY 1"""
)
def upsert_outcomes(s, d):
    return linking.upsert(table(s, d, "literature_sources"), _incoming(s, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register(
    f"""WITH {_inc}, n AS (SELECT m.matched_id, arg_max(i, m.raw_id) AS i FROM m JOIN (SELECT raw_id, {{'title': title, 'ik': ik, 'ck': ck, 'doi': doi}} AS i FROM inc) USING (raw_id) WHERE matched_id IS NOT NULL GROUP BY 1)
    SELECT s.id, CASE WHEN n.i IS NULL THEN s.title ELSE n.i.title END AS title, CASE WHEN n.i IS NULL THEN s.provider_item_key ELSE coalesce(n.i.ik, s.provider_item_key) END AS provider_item_key,
      CASE WHEN n.i IS NULL THEN s.citation_key ELSE coalesce(n.i.ck, s.citation_key) END AS citation_key, CASE WHEN n.i IS NULL THEN s.doi ELSE n.i.doi END AS doi, CASE WHEN n.i IS NULL THEN 'kept' ELSE 'updated' END AS outcome
      FROM literature_sources s LEFT JOIN n ON s.id = n.matched_id
    UNION ALL SELECT (SELECT max(id) FROM literature_sources) + raw_id, title, ik, ck, doi, 'inserted' FROM inc JOIN m USING (raw_id) WHERE m.matched_id IS NULL"""
)
def upserted_sources(s, d):
    u = linking.upsert(table(s, d, "literature_sources"), _incoming(s, d))
    return u.select("id", "title", "provider_item_key", "citation_key", "doi", "outcome")


@register()
def greedy_dedupe(s, d):
    src = table(s, d, "literature_sources")
    tagged = lambda t, c: F.concat(F.lit(t + ":"), F.lower(tx.empty_to_null(F.col(c))))
    keys = F.filter(F.array(tagged("doi", "normalized_doi"), tagged("zotero", "provider_item_key"), tagged("cite", "citation_key")), lambda x: x.isNotNull())
    return linking.greedy_dedupe(src.withColumn("keys", keys), "id", "id", "keys")


@register(
    """WITH st AS (SELECT DISTINCT document_id, normalized_label FROM candidate_terms WHERE review_status = 'approved')
    SELECT min(c.id) AS id FROM candidate_terms c WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.document_id IS NOT DISTINCT FROM c.document_id AND st.normalized_label IS NOT DISTINCT FROM c.normalized_label)
    GROUP BY c.document_id, c.normalized_label"""
)
def new_candidates(s, d):
    """Labels of a document of which none is approved yet, the first row of each."""
    t = table(s, d, "candidate_terms")
    return linking.new_rows(t.where("review_status = 'approved'"), t, ["document_id", "normalized_label"], "id").select("id")


@register(
    "SELECT id, CASE WHEN n = 0 THEN f ELSE regexp_replace(f, '(\\.[^.]*)?$', '_' || n || '\\1') END AS unique_name FROM (SELECT id, d.filename AS f, row_number() OVER (PARTITION BY d.filename ORDER BY id) - 1 AS n FROM literature_documents d)"
)
def unique_names(s, d):
    return linking.unique_names(table(s, d, "literature_documents"), "filename", "id").select("id", "unique_name")


_pk = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@register(
    f"""WITH t AS (SELECT meta_id AS id, {_pk('title')} AS key FROM paper_metadata WHERE title IS NOT NULL), g AS (SELECT {_pk('title')} AS key, min(id) AS ord FROM literature_sources GROUP BY 1),
    e AS (SELECT t.id, ord, 'exact' AS rule FROM t JOIN g USING (key)),
    p AS (SELECT t.id, min(ord) AS ord FROM t JOIN g ON length(t.key) >= 40 AND length(g.key) >= 40 AND (starts_with(t.key, g.key) OR starts_with(g.key, t.key)) WHERE t.id NOT IN (SELECT id FROM e) GROUP BY 1)
    SELECT * FROM e UNION ALL SELECT id, ord, 'prefix' FROM p"""
)
def prefix_matches(s, d):
    t = table(s, d, "paper_metadata").where("title is not null").select(F.col("meta_id").alias("id"), tx.title_key_pipeline("title").alias("key"))
    return linking.prefix_matches(t, table(s, d, "literature_sources").select(F.col("id").alias("ord"), tx.title_key_pipeline("title").alias("key")))


@register(
    """WITH d AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE suffix = '.pdf' AND coalesce(content, '') = '') AS scanned, count(*) FILTER (WHERE coalesce(trim(content), '') <> '') AS texts FROM literature_documents WHERE source_id IS NOT NULL GROUP BY 1)
    SELECT id, CAST(coalesce(n, 0) AS INTEGER) AS documents, list_sort(list_filter([CASE WHEN coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN n IS NULL THEN 'missing_attachment' END,
      CASE WHEN coalesce(texts, 0) = 0 THEN 'missing_full_text' END, CASE WHEN coalesce(texts, 0) = 0 AND coalesce(abstract, '') = '' THEN 'missing_text_content' END,
      CASE WHEN coalesce(scanned, 0) > 0 THEN 'possible_scanned_pdf' END], lambda x: x IS NOT NULL)) AS quality_flags FROM literature_sources LEFT JOIN d ON id = d.source_id"""
)
def quality_flags(s, d):
    return linking.group_documents(table(s, d, "literature_sources"), table(s, d, "literature_documents")).select("id", "documents", "quality_flags")


@register(
    """WITH p AS (SELECT lpad(CAST(meta_id AS VARCHAR), 12, '0') AS file, lower(zotero_item_key) || '-' || CAST(meta_id AS VARCHAR) AS pid, lower(doi) AS pd, lower(title) AS pt FROM paper_metadata WHERE zotero_item_key IS NOT NULL),
    h AS (SELECT s.id, file FROM literature_sources s JOIN p ON lower(s.normalized_doi) = pd AND pd <> '' UNION ALL SELECT s.id, file FROM literature_sources s JOIN p ON lower(s.title) = pt AND pt <> ''
      UNION ALL SELECT s.id, file FROM literature_sources s JOIN p ON contains(pid, lower(s.provider_item_key)) AND s.provider_item_key <> ''),
    m AS (SELECT id, min(file) AS file FROM h GROUP BY id)
    SELECT 'source-' || s.id AS entry_id, file FROM literature_sources s LEFT JOIN m USING (id)
    UNION ALL SELECT 'markdown-' || n, file FROM (SELECT file, row_number() OVER (ORDER BY file) AS n FROM p) WHERE file NOT IN (SELECT file FROM m)"""
)
def entries(s, d):
    p = table(s, d, "paper_metadata").where("zotero_item_key is not null")
    p = p.select(F.lpad(F.col("meta_id").cast("string"), 12, "0").alias("file"), F.concat_ws("-", F.lower("zotero_item_key"), F.col("meta_id").cast("string")).alias("paper_id"), "doi", "title")
    return linking.entries(table(s, d, "literature_sources"), p).select("entry_id", "file")


# --- vocabulary -----------------------------------------------------------------------------------

_lk = lambda x: _collapse(f"lower({x})")


@register(
    f"WITH t AS (SELECT {_lk('label')} AS k, arg_min(term_id, ord) AS term_id FROM ontology_terms WHERE label IS NOT NULL GROUP BY 1) SELECT label, term_id FROM (SELECT DISTINCT label FROM candidate_terms WHERE label IS NOT NULL) JOIN t ON {_lk('label')} = k"
)
def exact_terms(s, d):
    return vocabulary.exact_lookup(table(s, d, "candidate_terms"), table(s, d, "ontology_terms"))


@register(
    f"""WITH n AS (SELECT DISTINCT term_id, n FROM (SELECT term_id, {_lk('x')} AS n FROM (SELECT term_id, unnest(list_concat([label], coalesce(synonyms, []))) AS x FROM ontology_terms)) WHERE n <> ''),
    l AS (SELECT label, {_lk('label')} AS l FROM (SELECT DISTINCT label FROM candidate_terms WHERE label IS NOT NULL))
    SELECT label, term_id, max(CASE WHEN l = n THEN 1.0 ELSE 0.85 END)::DOUBLE AS score FROM l JOIN n ON contains(l, n) OR contains(n, l) WHERE l <> '' GROUP BY 1, 2"""
)
def contained_terms(s, d):
    return vocabulary.contained_matches(table(s, d, "candidate_terms"), table(s, d, "ontology_terms"))


@register()
def matched_terms_top5(s, d):
    """Top terms by the best of label and synonyms."""
    return sim.match_terms(table(s, d, "candidate_terms"), table(s, d, "ontology_terms"))


_view = "(SELECT * FROM ontology_terms ORDER BY ord LIMIT 80)"


@register(f"SELECT term_id AS id, label, false AS placeholder FROM {_view} UNION ALL SELECT DISTINCT p, p, true FROM (SELECT unnest(parents) AS p FROM {_view}) WHERE p NOT IN (SELECT term_id FROM {_view})")
def graph_nodes(s, d):
    return vocabulary.graph(table(s, d, "ontology_terms"))[0]


@register(f"SELECT term_id AS source, unnest(parents) AS target, 'subClassOf' AS label FROM {_view}")
def graph_edges(s, d):
    return vocabulary.graph(table(s, d, "ontology_terms"))[1]


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT term_id, unnest(parents) AS p FROM ontology_terms), r AS (SELECT term_id, p AS ancestor, 1 AS distance FROM e UNION SELECT r.term_id, e.p, r.distance + 1 FROM r JOIN e ON r.ancestor = e.term_id WHERE r.distance < (SELECT count(*) FROM ontology_terms))
    SELECT term_id, ancestor, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY 1, 2"""
)
def term_ancestors(s, d):
    return vocabulary.ancestors(table(s, d, "ontology_terms"))


# --- exports --------------------------------------------------------------------------------------


_q = "coalesce(evidence[1].quoted_text, '')"
_syn = "coalesce(array_to_string(synonyms, '; '), '')"


@register(
    f"""SELECT candidate_id AS "ID", label AS "LABEL", 'owl:Class' AS "TYPE", coalesce(proposed_definition, '') AS definition, coalesce(proposed_parent, '') AS parent, {_syn} AS synonyms, '' AS xref, '' AS notes,
    '' AS curator_decision, '' AS selected_ols_match, '' AS selected_local_match, coalesce(CAST(document_id AS VARCHAR), '') AS source_document_id, {_q} AS evidence FROM candidate_terms"""
)
def template_rows(s, d):
    return exports.template_rows(table(s, d, "candidate_terms"))


@register(
    f"""SELECT candidate_id, label, coalesce(proposed_definition, '') AS definition, review_status AS status, printf('%.3f', confidence_score) AS confidence, coalesce(proposed_parent, '') AS parent, '' AS selected_ols_label,
    '' AS selected_ols_ontology, '' AS selected_ols_iri, '' AS selected_local_label, '' AS selected_local_iri, '' AS curator_decision, document_id AS source_document_id, {_q} AS evidence, '' AS rationale FROM candidate_terms"""
)
def candidate_rows(s, d):
    return exports.candidate_rows(table(s, d, "candidate_terms"))


_yq = lambda k: f"'\"' || replace(replace({k}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@register(
    f"""WITH p AS (SELECT paper_key, min(section_id) AS first_id, string_agg('### ' || coalesce(nullif(heading, ''), 'Section') || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY section_no, section_id) FILTER (WHERE coalesce(text, '') <> '') AS parts,
      arg_min(text, (section_no, section_id)) FILTER (WHERE heading = 'Abstract') AS abstract FROM sections_flat WHERE paper_key IS NOT NULL GROUP BY 1)
    SELECT paper_key, md5({_strip(f"concat_ws(chr(10), '---', 'id: ' || {_yq('paper_key')}, 'title: ' || {_yq('paper_key')}, '---', '', '# ' || paper_key, '', '## Abstract', '', coalesce(abstract, ''), '', '## Notes', '', '', '', '## Extracted ontology-relevant information', '', coalesce(parts, ''))")} || chr(10)) AS rendered FROM p"""
)
def rendered_papers(s, d):
    t = table(s, d, "sections_flat").where("paper_key is not null")
    each = F.array_sort(F.collect_list(F.struct("section_no", "section_id", "heading", "text")))
    p = t.groupBy("paper_key").agg(F.transform(each, lambda x: F.struct(x["heading"].alias("heading"), x["text"].alias("text"))).alias("sections"), F.min_by(F.when(F.col("heading") == "Abstract", F.col("text")), F.when(F.col("heading") == "Abstract", F.struct("section_no", "section_id"))).alias("abstract"))
    return exports.paper_markdown(p.withColumn("id", F.col("paper_key")).withColumn("title", F.col("paper_key")), keep=["paper_key"]).select("paper_key", F.md5("value").alias("rendered"))


@register(
    f"SELECT paper_key, md5(string_agg(text, '{chr(10)}{chr(10)}---{chr(10)}{chr(10)}' ORDER BY section_id)) AS corpus, count(*) AS blocks FROM sections_flat WHERE text IS NOT NULL AND paper_key IS NOT NULL GROUP BY 1"
)
def combined_papers(s, d):
    c = exports.combined(table(s, d, "sections_flat").where("paper_key is not null"), "paper_key", "section_id", "text")
    return c.select("paper_key", F.md5("corpus").alias("corpus"), "blocks")


_folder = "lower(regexp_extract(path, '([^/]*)/[^/]*$', 1))"
_sr = " + ".join(f"(CASE WHEN contains(lower(d.filename), '{w}') THEN 3 ELSE 0 END) + (CASE WHEN contains({_folder}, '{w}') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(split_part(coalesce(content, ''), chr(12), 1)), '{w}') THEN 1 ELSE 0 END)" for w in ("crystal", "inbox", "4"))


@register(f"SELECT id, CAST({_sr} AS INTEGER) AS score FROM literature_documents d WHERE ({_sr}) > 0")
def storage_rank(s, d):
    return vocabulary.storage_rank(table(s, d, "literature_documents"), ["crystal", "inbox", "4"]).select("id", "score")


@register("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM events GROUP BY 1")
def audit_rollup(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))
