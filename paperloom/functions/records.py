"""Library records of both JSON shapes as one schema; tolerant JSON; metadata projections.

A record is an *API* record if it holds an object ``data``, else an *export* record. '' counts as
missing everywhere, so the first filled alias wins. A record that is no JSON object, has no title, or
is an attachment, note or annotation gives no row; ``record_outcomes`` counts these by reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Item types that are no papers.
NOT_PAPERS = ("attachment", "note", "annotation")


def parsed(raw: Column) -> Column:
    """The object behind JSON text; NULL for malformed text and for what is no object. Differently cased names are different fields."""
    return F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{"), raw)


def _first(raw: Column, *paths: str) -> Column:
    """The first filled value among JSON paths, as stripped text."""
    return F.coalesce(*(tx.clean_string(F.get_json_object(raw, "$." + p)) for p in paths))


def _list(raw: Column, *paths: str) -> Column:
    """The elements, as text, of the first path that holds a non-empty list."""
    each = [F.from_json(F.get_json_object(raw, "$." + p), "array<string>") for p in paths]
    return F.coalesce(*(F.when(F.size(e) > 0, e) for e in each), F.array().cast("array<string>"))


def is_api(raw: Column) -> Column:
    """Does the record hold its fields in an object ``data``?"""
    return F.coalesce(F.ltrim(F.get_json_object(raw, "$.data")).startswith("{"), F.lit(False))


def creators(raw: Column, *paths: str) -> Column:
    """(family, given, type) of each object of a list; the type defaults to author."""
    objects = F.filter(_list(raw, *paths), lambda x: F.ltrim(x).startswith("{"))
    return F.transform(
        objects,
        lambda x: F.struct(
            _first(x, "lastName", "family").alias("family"), _first(x, "firstName", "given").alias("given"), F.coalesce(_first(x, "creatorType"), F.lit("author")).alias("type")
        ),
    )


def tag_texts(raw: Column, *paths: str) -> Column:
    """strings and the ``tag`` of objects, stripped, without empty ones."""
    value = lambda x: F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.tag")).otherwise(x)
    return F.filter(F.transform(_list(raw, *paths), lambda x: tx.clean_string(value(x))), lambda x: x.isNotNull())


def _year(raw: Column) -> Column:
    """The first date part of an export record, else the first four digits of its date."""
    part = tx.clean_string(F.get_json_object(raw, "$.issued.date-parts[0][0]"))
    issued = F.get_json_object(raw, "$.issued")
    loose = F.when(F.ltrim(issued).startswith("{"), F.lit(None)).otherwise(issued)
    return F.coalesce(part, tx.year_any(tx.clean_string(loose)), tx.year_any(_first(raw, "date")))


def source_records(df: DataFrame, ident: str, raw: str = "raw") -> DataFrame:
    """One row per record with a title, of either shape."""
    j = df.select(ident, parsed(F.col(raw)).alias("j")).where("j is not null").withColumn("api", is_api(F.col("j")))
    r = F.col("j")
    pick = lambda export, api: F.when(F.col("api"), _first(r, *api)).otherwise(_first(r, *export))
    item_type = pick(("type", "itemType"), ("data.itemType",))
    extra = tx.clean_string(F.regexp_extract(_first(r, "data.extra"), r"(?imd)^\s*Citation Key:\s*(.+?)\s*$", 1))
    api_creators, own_creators = creators(r, "data.creators"), creators(r, "author", "creators")
    out = j.select(
        ident, "api", pick(("id", "key"), ("key", "data.key")).alias("provider_item_key"),
        F.coalesce(pick(("citationKey",), ("data.citationKey", "citationKey")), F.when(F.col("api"), extra)).alias("citation_key"),
        pick(("title",), ("data.title",)).alias("title"), item_type.alias("item_type"),
        F.when(F.col("api"), api_creators).otherwise(own_creators).alias("creators"),
        F.when(F.col("api"), tx.year_any(_first(r, "data.date"))).otherwise(_year(r)).alias("year"),
        tx.normalize_doi(pick(("DOI", "doi"), ("data.DOI", "data.doi"))).alias("doi"), pick(("URL", "url"), ("data.url", "data.URL")).alias("url"),
        pick(("abstract", "abstractNote"), ("data.abstractNote", "data.abstract")).alias("abstract"),
        F.when(F.col("api"), tag_texts(r, "tags", "data.tags")).otherwise(tag_texts(r, "tag", "tags")).alias("tags"),
        F.when(F.col("api"), tag_texts(r, "collections", "data.collections")).otherwise(tag_texts(r, "collection", "collections")).alias("collections"),
        F.when(F.col("api"), tx.to_int(_first(r, "version", "data.version"))).alias("version"),
    )
    return out.where(F.col("title").isNotNull() & ~(F.col("api") & F.coalesce(F.col("item_type").isin(*NOT_PAPERS), F.lit(False))))


def record_outcomes(df: DataFrame, ident: str, raw: str = "raw") -> DataFrame:
    """(outcome, n): records, and the others by reason."""
    j = parsed(F.col(raw))
    title = F.when(is_api(j), _first(j, "data.title")).otherwise(_first(j, "title"))
    drop = is_api(j) & F.coalesce(_first(j, "data.itemType").isin(*NOT_PAPERS), F.lit(False))
    why = F.when(F.try_parse_json(raw).isNull(), "malformed").when(j.isNull(), "not_an_object").when(drop, "not_a_paper").when(title.isNull(), "no_title").otherwise("record")
    return df.select(ident, why.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def is_pdf_attachment(raw: Column) -> Column:
    """An attachment whose kind, name or title says PDF."""
    low = lambda *paths: F.lower(F.coalesce(_first(raw, *paths), F.lit("")))
    pdf = (low("data.contentType", "data.mimeType") == "application/pdf") | low("data.filename", "data.title", "filename").endswith(".pdf") | F.contains(low("data.title", "title"), F.lit("pdf"))
    return (low("data.itemType", "itemType") == "attachment") & pdf


def paper_metadata(df: DataFrame, ident: str, raw: str = "raw", collection: str = "") -> DataFrame:
    """Citation fields of API records; only authors are named, '' where nothing is stated."""
    r = F.col(raw)
    said = lambda *paths: F.coalesce(_first(r, *paths), F.lit(""))
    people = F.filter(_list(r, "data.creators"), lambda x: F.coalesce(F.get_json_object(x, "$.creatorType"), F.lit("author")) == "author")
    name = lambda x: F.coalesce(tx.empty_to_null(F.concat_ws(" ", _first(x, "firstName"), _first(x, "lastName"))), _first(x, "name"))
    authors = F.filter(F.transform(people, name), lambda x: x.isNotNull())
    lead = F.coalesce(F.element_at(F.split(F.trim(F.split_part(F.get(authors, F.lit(0)), F.lit(","), F.lit(1))), r"\s+"), -1), F.lit(""))
    year = F.coalesce(tx.year_century(_first(r, "data.date", "data.year")), F.lit(""))
    keywords = F.filter(F.transform(_list(r, "data.tags"), lambda x: tx.clean_string(F.get_json_object(x, "$.tag"))), lambda x: x.isNotNull())
    return df.select(
        ident, F.coalesce(_first(r, "data.title"), F.lit("Untitled paper")).alias("title"), said("data.DOI", "data.doi").alias("doi"),
        F.concat_ws(" ", F.when(lead != "", F.concat(lead, F.lit(" et al."))), tx.empty_to_null(year)).alias("citation"), authors.alias("authors"), year.alias("year"),
        said("data.publicationTitle", "data.journalAbbreviation").alias("journal"), said("data.volume").alias("volume"), said("data.issue").alias("issue"),
        said("data.pages", "data.number").alias("pages_or_article_number"), said("key", "data.key").alias("item_key"), F.lit(collection).alias("collection"),
        said("data.abstractNote").alias("abstract"), keywords.alias("keywords"), lead.alias("lead_author"),
    )


def json_list(c: Column) -> Column:
    """The elements of a JSON list as text; malformed, missing and other values give an empty list."""
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The parsed value, or the default for malformed or empty text."""
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)), default)


def next_link(c: Column) -> Column:
    """The address of the following page in a Link header, else NULL."""
    return tx.empty_to_null(F.regexp_extract(c, r'<([^>]*)>\s*;[^,]*\brel="?next"?', 1))


def api_url(base: str, library: Column, library_id: Column, collection: Column, key: Column) -> Column:
    """Address of the items of a library or collection, of one item, or of its children."""
    root = F.concat(F.lit(base.rstrip("/") + "/"), F.when(library == "group", F.lit("groups/")).otherwise(F.lit("users/")), library_id)
    return F.when(key.isNotNull(), F.concat(root, F.lit("/items/"), key)).when(collection.isNotNull(), F.concat(root, F.lit("/collections/"), collection, F.lit("/items"))).otherwise(F.concat(root, F.lit("/items")))


def resolve_names(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, key) of each wanted name: the entry of that key, else the first whose name is equal without case.

    wanted: name; listed: ord, key, label.
    """
    by_key = wanted.join(listed.select(F.col("key").alias("name"), F.col("key"), F.lit(0).alias("way"), "ord"), "name")
    names = listed.select(F.lower("label").alias("low"), "key", F.lit(1).alias("way"), "ord")
    by_name = wanted.withColumn("low", F.lower("name")).join(names, "low").select("name", "key", "way", "ord")
    return by_key.select("name", "key", "way", "ord").unionByName(by_name).groupBy("name").agg(F.min_by("key", F.struct("way", "ord")).alias("key"))


def export_rows(df: DataFrame) -> DataFrame:
    """(id, value): the JSON of a literature export; the paper's own fields before its metadata's.

    df: id, title, authors, year, doi, pmid, abstract, notes, path, meta map<string,string>.
    """
    own = lambda c, k: F.coalesce(tx.empty_to_null(F.col(c).cast("string")), tx.empty_to_null(F.col("meta")[k]))
    fields = [own(n, n).alias(n) for n in ("id", "title")] + [F.coalesce("authors", F.array().cast("array<string>")).alias("authors")] + [own(n, n).alias(n) for n in ("year", "doi", "pmid")]
    more = [F.col("meta")["pmcid"].alias("pmcid"), F.coalesce(tx.empty_to_null(F.col("meta")["zotero_key"]), F.col("meta")["id"]).alias("zotero_key")]
    rest = [F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("notes", F.lit("")).alias("relevant_text"), F.col("path").alias("source_file")]
    return df.select("id", F.to_json(F.struct(*fields, *more, *rest), {"ignoreNullFields": "false"}).alias("value"))
