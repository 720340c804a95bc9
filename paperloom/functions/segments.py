"""Segmentation of texts into pages, lines, sections, sentences, chunks and claims."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Headings that open a section without a number.
CANONICAL = (
    "abstract", "summary", "introduction", "background", "methods", "methodology", "materials_and_methods", "experimental_procedures",
    "results", "findings", "discussion", "conclusion", "conclusions", "references", "bibliography",
)
#: Words by which a sentence looks like a claim.
CLAIM_CUES = ("we ", "results", "show", "demonstrate", "indicate", "suggest", "found", "measured", "method", "model", "limited")
#: Words that are no key terms, and words that start no candidate phrase.
NO_TERMS = ("which", "there", "their", "these", "those", "using", "therefore", "paper", "study", "result")
NO_PHRASES = ("candidate", "candidates", "curator", "extract", "focus", "source", "terms", "ontology", "paper", "from", "with", "that", "this")
#: Phrases per text.
PHRASES = 5
#: Hints and small words of unnumbered headings.
HEADING_HINTS = ("framework", "monitoring", "processing", "solution", "method", "model", "data_acquisition")
SMALL_WORDS = ("and", "or", "of", "the", "in", "for")


def pages(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, page_number, text); blank pages consume a number and give no row."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\f")).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("page_number"), tx.strip("text").alias("text")).where("text <> ''")


def line_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): stripped lines that are not blank, numbered over all lines."""
    return df.select(key, F.posexplode(tx.lines(text)).alias("line_no", "line")).select(key, "line_no", tx.strip("line").alias("line")).where("line <> ''")


def parsed_heading(c: Column) -> Column:
    """struct(heading, key, level) of a numbered or canonical heading, else NULL."""
    s = tx.strip(c)
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$", 1)
    body = tx.strip(F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$", 2))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    numbered = (number != "") & (F.length(body) <= 120) & (F.size(tx.words(body)) <= 12) & ~body.rlike(r"\(\d{4}\)") & ~(F.contains(body, F.lit(",")) & (dots == 0))
    return F.when(numbered, F.struct(body.alias("heading"), tx.heading_key(body).alias("key"), (dots + 1).alias("level"))).when(
        tx.heading_key(s).isin(*CANONICAL), F.struct(s.alias("heading"), tx.heading_key(s).alias("key"), F.lit(1).alias("level"))
    )


def look_ahead_heading(c: Column, nxt: Column) -> Column:
    """An unnumbered line that looks like a heading, judged with the next line."""
    s = tx.strip(c)
    ws = tx.words(s)
    n = F.size(ws)
    like = F.size(F.filter(ws, lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) | F.lower(w).isin(*SMALL_WORDS)))
    hint = F.lit(False)
    for h in HEADING_HINTS:
        hint = hint | F.contains(tx.heading_key(s), F.lit(h))
    shape = (F.length(s) <= 90) & n.between(2, 10) & ~s.rlike(r"[.,;:]$") & s.rlike(r"(?U)\p{Alpha}") & (F.size(tx.words(nxt)) >= 5)
    return F.coalesce(shape & ((like / n >= 0.65) | (hint & (F.length(nxt) >= 80))), F.lit(False))


def sections(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Flat sections (key, section_no, parent_no, level, heading, heading_key, text) in order.

    Text before the first heading is section 0 at level 0. The parent is the last earlier section of
    a smaller level. Windows run within one document.
    """
    ls = line_rows(df, key, text)
    w = Window.partitionBy(key).orderBy("line_no")
    ls = ls.withColumn("h", parsed_heading(F.col("line"))).withColumn("nxt", F.lead("line").over(w))
    ahead = F.col("h").isNull() & look_ahead_heading(F.col("line"), F.col("nxt"))
    ls = ls.withColumn("h", F.coalesce("h", F.when(ahead, F.struct(F.col("line").alias("heading"), tx.heading_key("line").alias("key"), F.lit(1).alias("level")))))
    ls = ls.withColumn("section_no", F.sum(F.col("h").isNotNull().cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    out = ls.groupBy(key, "section_no").agg(F.max("h").alias("h"), body.alias("text"))
    out = out.select(key, "section_no", F.coalesce("h.level", F.lit(0)).alias("level"), F.coalesce("h.heading", F.lit("Front matter")).alias("heading"), F.coalesce("h.key", F.lit("front_matter")).alias("heading_key"), "text")
    o = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("section_no", "level")).over(o)
    return out.withColumn("parent_no", F.array_max(F.transform(F.filter(before, lambda b: (b["level"] < F.col("level")) & (b["level"] > 0)), lambda b: b["section_no"])))


def pack_paragraphs(c: Column, most: int) -> Column:
    """Blank-line paragraphs packed up to ``most`` characters; longer ones sliced."""
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), tx.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > most, F.struct(F.concat(flushed, slices).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) > most, F.struct(flushed.alias("done"), p.alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("open")))
        )

    packed = F.aggregate(paragraphs, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return F.when(F.length(c) <= most, F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))).otherwise(packed)


def section_chunks(df: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """(key, chunk_no, chunk)."""
    return df.select(key, F.posexplode(pack_paragraphs(F.col(text), most)).alias("chunk_no", "chunk"))


def token_chunks(c: Column, target: int = 1200, most: int = 1500) -> Column:
    """Paragraphs of one section packed by estimated tokens."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), tx.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        over = (acc["open"] != "") & (tx.tokens_by_words(joined) > most)
        done = F.when(over, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        cur = F.when(over, p).otherwise(joined)
        full = tx.tokens_by_words(cur) >= target
        return F.struct(F.when(full, F.array_append(done, cur)).otherwise(done).alias("done"), F.when(full, F.lit("")).otherwise(cur).alias("open"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def retrieval_chunks(sections_df: DataFrame) -> DataFrame:
    """T17 over flat sections (paper_key, section_no, heading_path, page_start, page_end, text).

    The counter runs over a paper in section order.
    """
    each = sections_df.where("text is not null").select("paper_key", "section_no", "heading_path", "page_start", "page_end", F.posexplode(token_chunks(F.col("text"))).alias("k", "chunk"))
    w = Window.partitionBy("paper_key").orderBy("section_no", "k")
    n = F.row_number().over(w)
    return each.select(
        "paper_key", F.concat("paper_key", F.lit("_chunk_"), F.lpad(n.cast("string"), 4, "0")).alias("chunk_id"), tx.tokens_by_words("chunk").alias("approx_tokens"),
        tx.chunk_type(F.array_join("heading_path", " ")).alias("chunk_type"), tx.page_range("page_start", "page_end").alias("pages"), "chunk",
    )


def sentences(c: Column) -> Column:
    """Parts after ., ! or ? and white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), tx.strip), lambda s: s != "")


def looks_like_claim(c: Column, cues: tuple[str, ...] = CLAIM_CUES) -> Column:
    """P10: at least eight words and one of the cues."""
    hit = F.lit(False)
    for cue in cues:
        hit = hit | F.contains(F.lower(c), F.lit(cue))
    return (F.size(tx.words(c)) >= 8) & hit


def claims(sections_df: DataFrame, most: int = 30) -> DataFrame:
    """The first claims of each paper in section order, with type and pages."""
    kind = tx.chunk_type("heading")
    each = sections_df.withColumn("kind", kind).where(~F.col("kind").isin("reference", "declaration", "table", "figure_caption"))
    each = each.select("paper_key", "section_no", "heading", "page_start", "page_end", "kind", F.posexplode(sentences(F.col("text"))).alias("k", "claim")).where(looks_like_claim(F.col("claim")))
    n = F.row_number().over(Window.partitionBy("paper_key").orderBy("section_no", "k"))
    return each.withColumn("n", n).where(F.col("n") <= most).select(
        "paper_key", F.concat("paper_key", F.lit("_claim_"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("claim_id"), "claim", "heading",
        tx.page_range("page_start", "page_end").alias("pages"), F.when(F.col("kind").isin("method", "result", "conclusion"), F.col("kind")).otherwise("background").alias("type"),
    )


def key_terms(df: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """The most frequent words of each document; first-seen casing, ties by word."""
    found = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z][A-Za-z0-9-]{4,}"), F.lit(0))
    each = df.select(key, F.posexplode(found).alias("pos", "word")).withColumn("k", F.lower("word")).where(~F.col("k").isin(*NO_TERMS))
    n = each.groupBy(key, "k").agg(F.count(F.lit(1)).alias("n"), F.min_by("word", "pos").alias("term"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "k"))
    return n.withColumn("rank", r).where(F.col("rank") <= most).select(key, "rank", "term", "n")


_phrase_word = re.compile("[a-z][a-z-]{3,}")
_no_phrases = frozenset(NO_PHRASES)


def _phrases(text: str | None) -> list[str] | None:
    if text is None:
        return None
    ws = [w for w in _phrase_word.findall(text.lower()) if w not in _no_phrases]
    out: dict[str, None] = {}
    for a, b in zip(ws, ws[1:], strict=False):
        out[f"{a} {b}"] = None
        if len(out) == PHRASES:
            break
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidate_phrases(c: pd.Series) -> pd.Series:
    """The first distinct pairs of neighbouring words, in one linear pass per text."""
    return c.map(_phrases)


def generated_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Up to three candidate labels per document with an evidence window."""
    each = df.select(key, F.col(text).alias("body"), F.posexplode(F.slice(candidate_phrases(F.col(text)), 1, 3)).alias("k", "label"))
    return each.select(key, "k", "label", F.lit(0.42).alias("confidence_score"), tx.evidence("body", "label").alias("quoted_text"))
