"""JSON, front matter and contract checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

CREATOR = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "type")])
EVIDENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("quoted_text", "section_title")]
    + [T.StructField(n, T.IntegerType()) for n in ("page_number", "char_start", "char_end")]
    + [T.StructField("direct_or_inferred", T.StringType())]
)
CANDIDATE = T.StructType(
    [
        T.StructField("label", T.StringType()), T.StructField("proposed_definition", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("proposed_parent", T.StringType()), T.StructField("confidence_score", T.DoubleType()), T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)
#: Evidence modes, required fields of a curation suggestion and of a suggestion payload.
MODES = ("direct", "inferred", "contextual")
SUGGESTION_FIELDS = (
    "suggestion_type", "proposed_label", "existing_ontology_id", "proposed_definition", "synonyms", "parent_class", "relations",
    "source_literature_ids", "supporting_quotes_or_summaries", "confidence", "rationale",
)
PAYLOAD_FIELDS = ("proposed_label", "definition", "synonyms", "source_literature_ids", "confidence", "rationale")
CSL_ITEM = (
    "id STRING, key STRING, citationKey STRING, title STRING, type STRING, itemType STRING, author ARRAY<STRUCT<family: STRING, given: STRING, type: STRING>>, "
    "issued STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, date STRING, DOI STRING, URL STRING, abstract STRING, abstractNote STRING, `container-title` STRING, volume STRING, page STRING, language STRING"
)


def csl_item(raw: Column) -> Column:
    """The record; malformed JSON or no object gives NULL."""
    return F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{"), F.from_json(raw, CSL_ITEM))


def csl_projection(df: DataFrame, ident: str, raw: str = "raw") -> DataFrame:
    """One row per record with a title; the first filled alias wins, '' counts as missing."""
    j = df.select(ident, csl_item(F.col(raw)).alias("j"))
    pick = lambda *names: F.coalesce(*(tx.clean_string(F.col(f"j.`{n}`")) for n in names))
    year = F.coalesce(F.get(F.get(F.col("j.issued.`date-parts`"), F.lit(0)), F.lit(0)).cast("string"), tx.year_any(F.col("j.date")))
    creators = F.transform("j.author", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), F.coalesce(a["type"], F.lit("author")).alias("type")))
    out = j.select(
        ident, pick("id", "key").alias("provider_item_key"), pick("citationKey").alias("citation_key"), pick("title").alias("title"), pick("type", "itemType").alias("item_type"),
        creators.alias("creators"), year.alias("year"), tx.normalize_doi(pick("DOI")).alias("doi"), pick("URL").alias("url"), pick("abstract", "abstractNote").alias("abstract"),
    )
    return out.where("title is not null")


def skipped_items(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Records and rejects by reason."""
    j = csl_item(F.col(raw))
    reason = F.when(F.try_parse_json(raw).isNull(), "malformed").when(j.isNull(), "not_an_object").when(tx.clean_string(j["title"]).isNull(), "no_title").otherwise("record")
    return df.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def candidate_violations(c: Column) -> Column:
    """Codes of the rules that a parsed candidate breaks, in rule order."""
    blank = lambda x: tx.clean_string(x).isNull()
    checks = [
        ("blank_label", blank(c["label"])),
        ("score_range", c["confidence_score"].isNull() | ~c["confidence_score"].between(0, 1)),
        ("no_evidence", F.coalesce(F.size(c["evidence"]), F.lit(0)) <= 0),
        ("blank_quote", F.coalesce(F.exists(c["evidence"], lambda e: tx.clean_string(e["quoted_text"]).isNull()), F.lit(False))),
        ("bad_mode", F.coalesce(F.exists(c["evidence"], lambda e: ~F.coalesce(e["direct_or_inferred"].isin(*MODES), F.lit(False))), F.lit(False))),
    ]
    return F.filter(F.array(*(F.when(cond, F.lit(code)) for code, cond in checks)), lambda x: x.isNotNull())


def unknown_keys(raw: Column) -> Column:
    """Keys of a candidate object that the contract does not name."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in CANDIDATE.fields))))


def parse_candidates(raw: Column) -> Column:
    """The candidates array of a response; NULL for malformed JSON or extra top-level keys."""
    extra = F.array_except(F.json_object_keys(raw), F.array(F.lit("candidates")))
    return F.when(F.try_parse_json(raw).isNotNull() & (F.size(extra) == 0), F.from_json(raw, T.StructType([T.StructField("candidates", T.ArrayType(CANDIDATE))]))["candidates"])


def _kind(v: Column, path: str) -> Column:
    """The JSON type of a field of a parsed value: its first word, NULL if the field is absent."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _is_score(v: Column, path: str) -> Column:
    """A JSON number (or truth value, which counts as 0 or 1) within 0..1; text is none."""
    value = F.try_variant_get(v, path, "double")
    return F.coalesce(_kind(v, path).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN") & value.between(0, 1), F.lit(False))


def _codes(*checks: tuple[Column, Column | str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code) if isinstance(code, str) else code) for c, code in checks)), lambda x: x.isNotNull())


def _missing(raw: Column, fields: tuple[str, ...]) -> Column:
    have = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*map(F.lit, fields)), have))


def suggestion_problems(raw: Column) -> Column:
    """Missing fields (sorted) and confidence problems of one suggestion object; NULL gives NULL."""
    gone = F.transform(_missing(raw, SUGGESTION_FIELDS), lambda m: F.concat(F.lit("missing:"), m))
    bad = ~_is_score(F.try_parse_json(raw), "$.confidence")
    return F.when(raw.isNotNull(), F.concat(gone, F.when(bad, F.array(F.lit("confidence"))).otherwise(F.array().cast("array<string>"))))


def payload_problems(raw: Column) -> Column:
    """Missing fields (sorted), list types and confidence of one suggestion of a payload."""
    v = F.try_parse_json(raw)
    lists = [("synonyms", F.coalesce(_kind(v, "$.synonyms"), F.lit("ARRAY")) != "ARRAY"), ("source_literature_ids", F.coalesce(_kind(v, "$.source_literature_ids"), F.lit("ARRAY")) != "ARRAY")]
    kinds = _codes(*((c, f"not_a_list:{n}") for n, c in lists), (~_is_score(v, "$.confidence"), "confidence"))
    return F.when(raw.isNotNull(), F.concat(F.transform(_missing(raw, PAYLOAD_FIELDS), lambda m: F.concat(F.lit("missing:"), m)), kinds))


def response_problems(raw: Column) -> Column:
    """What is wrong with a whole response: its form, then each suggestion by its number from 1."""
    v = F.try_parse_json(raw)
    outer = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    form = (
        F.when(v.isNull(), F.array(F.lit("malformed")))
        .when(outer != "OBJECT", F.array(F.lit("not_an_object")))
        .when(F.coalesce(_kind(v, "$.suggestions"), F.lit("")) != "ARRAY", F.array(F.lit("no_suggestions_list")))
        .when(F.coalesce(_kind(v, "$.warnings"), F.lit("ARRAY")) != "ARRAY", F.array(F.lit("warnings_not_a_list")))
    )
    items = F.from_json(raw, "suggestions ARRAY<STRING>")["suggestions"]  # elements as JSON text
    each = F.transform(
        items,
        lambda x, i: F.transform(
            F.when(F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)), suggestion_problems(x)).otherwise(F.array(F.lit("not_an_object"))),
            lambda p: F.concat((i + 1).cast("string"), F.lit(" "), p),
        ),
    )
    return F.coalesce(form, F.flatten(each))


def aggregated_responses(df: DataFrame, key: str, order: str, raw: str = "raw") -> DataFrame:
    """Suggestions and warnings of all chunks of a run, in chunk order; responses with problems are left out."""
    ok = df.where(F.size(response_problems(F.col(raw))) == 0).select(key, order, F.from_json(raw, "suggestions ARRAY<STRING>, warnings ARRAY<STRING>").alias("j"))
    lists = ok.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col("j.suggestions").alias("s"), F.coalesce("j.warnings", F.array().cast("array<string>")).alias("w")))).alias("c"))
    return lists.select(key, F.flatten(F.transform("c", lambda x: x["s"])).alias("suggestions"), F.flatten(F.transform("c", lambda x: x["w"])).alias("warnings"))


def external_matches(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Rows of a term-search response; docs without label, ontology or iri are dropped."""
    doc = "STRUCT<label: STRING, ontology_name: STRING, iri: STRING, short_form: STRING, description: ARRAY<STRING>>"
    docs = F.from_json(raw, f"response STRUCT<docs: ARRAY<{doc}>>")["response"]["docs"]
    d = df.select(key, F.posexplode(docs).alias("pos", "d"))
    ok = (F.col("d.label") != "") & (F.col("d.ontology_name") != "") & (F.col("d.iri") != "")
    return d.where(ok).select(key, "pos", "d.label", F.col("d.ontology_name").alias("ontology"), "d.iri", F.col("d.short_form").alias("term_id"), F.get("d.description", F.lit(0)).alias("definition"))


def front_matter(value: Column) -> Column:
    """The block between the leading --- lines, else NULL."""
    m = F.regexp_extract(value, r"(?s)\A---\n(.*?)\n---", 1)
    return F.when(value.startswith("---\n") & (m != ""), m)


def front_matter_value(block: Column, key: str) -> Column:
    """A scalar of the block; the last of repeated keys wins, quotes are removed."""
    found = F.regexp_extract_all(block, F.lit(rf"(?md)^{key}:[ \t]*(.*)$"), F.lit(1))
    return F.regexp_replace(tx.clean_string(F.try_element_at(found, F.lit(-1))), r'^"(.*)"$', "$1")


def front_matter_list(block: Column, key: str) -> Column:
    """The items of a list value."""
    body = F.regexp_extract(block, rf"(?md)^{key}:[ \t]*\n((?:[ \t]+-[ \t].*(?:\n|\z))*)", 1)
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?md)^[ \t]+-[ \t]+(.*)$"), F.lit(1)), lambda x: F.regexp_replace(tx.strip(x), r'^"(.*)"$', "$1"))


def markdown_section(value: Column, name: str) -> Column:
    """Text between '## name' and the next '## '."""
    return tx.strip(F.regexp_extract(value, rf"(?imsd)^## {name}[ \t]*\n(.*?)(?=^## |\z)", 1))


def subsections(df: DataFrame, key: str, text: str) -> DataFrame:
    """J06: '###' parts (key, pos, heading, text); a text without one is one part."""
    parts = F.split(F.col(text), r"(?md)^### ")
    d = df.select(key, F.posexplode(parts).alias("pos", "part"), F.size(parts).alias("n"))
    d = d.where((F.col("n") == 1) | (F.col("pos") > 0))
    return d.select(key, "pos", F.when(F.col("n") > 1, tx.strip(F.split_part("part", F.lit("\n"), F.lit(1)))).alias("heading"), F.when(F.col("n") > 1, tx.strip(F.regexp_replace("part", r"\A[^\n]*\n?", ""))).otherwise(tx.strip("part")).alias("text"))
