"""Section trees, Markdown conversion and page chunks: one linear pass per text, in Arrow batches.

A whole text, or the ordered pages of a file, is one row, so nothing is shuffled to number lines or to
find parents: a pass keeps the open sections as a stack of at most one entry per level. Sections come
out flat, in reading order, with ``parent_no`` and ``heading_path``.

NULL texts give no rows; an empty text gives no section.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .segments import CANONICAL, HEADING_HINTS, SMALL_WORDS

#: Headings of the raw-text parser, and headings that end it.
SCIENTIFIC = (
    "abstract", "summary", "introduction", "background", "methods", "methodology", "materials_and_methods", "results", "discussion", "conclusion", "conclusions",
)
REFERENCE = ("references", "bibliography", "literature_cited")
#: Names of the section map and the headings that fill them, the first one wins.
SECTION_MAP = {
    "abstract": ("abstract", "summary"), "introduction": ("introduction", "background"),
    "methodology": ("methods", "methodology", "materials and methods", "experimental procedures"), "results": ("results", "findings"),
    "discussion": ("discussion",), "conclusion": ("conclusion", "conclusions"),
    "figures_tables": ("figure captions", "figures", "tables", "table captions"), "references": ("references", "bibliography"),
}
#: Lines that become second-level headings of a converted text.
COMMON_HEADINGS = (
    "abstract", "keywords", "references", "data availability", "declaration of competing interest", "credit authorship contribution statement",
    "acknowledgments", "acknowledgements", "appendix a supplementary data", "supplementary data", "funding", "author contributions",
    "conclusion", "conclusions", "discussion", "results", "methods", "materials and methods", "introduction",
)
#: Lines of page text that open a Markdown section.
PAGE_HEADING = (
    r"(?i)^(?:\d+\.(?:\d+\.){0,2}\s+[A-Z][A-Za-z0-9,\-:;()/ ]{3,}|A\s*B\s*S\s*T\s*R\s*A\s*C\s*T|Abstract|Keywords|References|Acknowledg(?:e)?ments|Supplementary material"
    r"|(?:Fig\.|Figure|Table)\s*\d+\.?.*)$"
)

_line_end = re.compile(tx.LINE_END.replace(r"\x{0085}", "\x85").replace(r"\x{2028}", " ").replace(r"\x{2029}", " "))
_numbered = re.compile(r"(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$")
_lead_number = re.compile(r"^\s*\d+(?:\.\d+)*\.?\s+")
_not_key = re.compile("[^a-z0-9]+")


def key_of(heading: str) -> str:
    """F09 of one string."""
    return _not_key.sub("_", _lead_number.sub("", heading.strip().casefold())).strip("_")


def numbering(line: str) -> tuple[int, str] | None:
    """(depth, rest) of a numbered line."""
    m = _numbered.match(line)
    return (m[1].count(".") + 1, m[2].strip()) if m else None


def filled_lines(text: str) -> list[str]:
    return [x for x in map(str.strip, _line_end.split(text)) if x]


def stated_heading(line: str) -> tuple[str, int] | None:
    """(heading, level) of a numbered or canonical line."""
    n = numbering(line)
    if n and len(n[1]) <= 120 and len(n[1].split()) <= 12 and not re.search(r"\(\d{4}\)", n[1]) and (n[0] > 1 or "," not in n[1]):
        return n[1], n[0]
    return (line, 1) if key_of(line) in CANONICAL else None


def guessed_heading(line: str, following: str | None) -> bool:
    """Does an unnumbered line look like a heading, given the line after it?"""
    ws = line.split()
    if not following or not 2 <= len(ws) <= 10 or len(line) > 90 or line[-1] in ".,;:" or len(following.split()) < 5 or not any(map(str.isalpha, line)):
        return False
    share = sum(w[0].isupper() or w.casefold() in SMALL_WORDS for w in ws) / len(ws)
    return share >= 0.65 or (len(following) >= 80 and any(h in key_of(line) for h in HEADING_HINTS))


class _Tree:
    """Flat sections in reading order; ``open`` holds (level, position) of the sections that can still take children."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.open: list[tuple[int, int]] = []
        self.counts: dict[int, int] = {}

    def add(self, heading: str, level: int, page: int | None = None, nests: bool = True) -> dict:
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        parent = self.open[-1][1] if self.open and nests else None
        row = {
            "section_no": len(self.rows), "parent_no": parent, "level": level, "heading": heading, "heading_key": key_of(heading), "page_start": page, "page_end": page,
            "heading_path": [*(self.rows[parent]["heading_path"] if parent is not None else []), heading], "section_order": 0.0, "body": [],
        }
        self.rows.append(row)
        if nests:
            self.open.append((level, row["section_no"]))
        return row

    def number(self, row: dict) -> None:
        """1, 2, ... at the top; below it parent.child read as a number, whatever the depth."""
        level = row["level"]
        self.counts = {k: n for k, n in self.counts.items() if k <= level}
        self.counts[level] = self.counts.get(level, 0) + 1
        row["section_order"] = float(self.counts[1]) if level <= 1 else float(f"{self.counts.get(1, 0)}.{self.counts[level]}")


def structured(pages: list[tuple[int, str]]) -> list[dict]:
    """Sections of the pages of a file; what stands before the first heading is 'Front matter' at level 0."""
    ls = [(x, n) for n, t in pages for x in filled_lines(t)]
    tree = _Tree()
    here = None
    for k, (line, page) in enumerate(ls):
        h = stated_heading(line)
        if h is None and guessed_heading(line, ls[k + 1][0] if k + 1 < len(ls) else None):
            h = (line, 1)
        if h:
            here = tree.add(*h, page)
            tree.number(here)
            continue
        if here is None:
            here = tree.add("Front matter", 0, page, nests=False)
        here["body"].append(line)
        here["page_end"] = page
    return tree.rows


def raw_sections(text: str) -> list[dict]:
    """Sections of a raw text up to its references; without a heading the whole text is one section."""
    tree = _Tree()
    here, ended = None, False
    for line in map(str.strip, _line_end.split(text)):
        n = numbering(line)
        name = n[1] if n else line
        known = bool(line) and key_of(name) in (*SCIENTIFIC, *REFERENCE)
        if known or (n and len(name) <= 120 and len(name.split()) <= 12):
            if key_of(name) in REFERENCE:
                ended = True
                break
            m = re.match(r"(\d+(?:\.\d+)*)", line)
            here = tree.add(name, m[1].count(".") + 1 if m else 1)
        elif here is not None and line:
            here["body"].append(line)
    if not tree.rows and text and not ended:
        tree.add("Full text", 1)["body"].append(re.split(r"(?im)^\s*(?:references|bibliography|literature cited)\s*$", text, maxsplit=1)[0].strip())
    return tree.rows


def page_level(line: str) -> int | None:
    """F35, page variant."""
    m = re.match(r"(\d+(?:\.\d+){0,3})\.?\s+.+$", line)
    if m:
        return min(2 + m[1].count("."), 4)
    if re.sub("[^a-z0-9 ]+", "", line.casefold()) in tx.SECTION_WORDS:
        return 2
    return 3 if re.match(r"(?i)(?:figure|fig)\.?\s+\d+|table\s+\d+", line) else None


def page_tree(pages: list[tuple[int, str]]) -> list[dict]:
    """Sections of cleaned pages below a leading 'Paper body'; top-level sections without text and children are left out."""
    tree = _Tree()
    here = tree.add("Paper body", 2, pages[0][0] if pages else None)
    here["page_end"] = None
    for n, text in pages:
        for line in filled_lines(text):
            level = page_level(line)
            if level is not None and len(line) <= 140:
                m = re.match(r"(?i)(?:(fig|figure)\.?|(table))\s+(\d+)", line)
                here = tree.add(f"{'Figure' if m[1] else 'Table'} {m[3]}" if m else line, level, n)
            else:
                here["body"].append(line)
                here["page_end"] = n
    parents = {r["parent_no"] for r in tree.rows}
    return [r for r in tree.rows if r["body"] or r["parent_no"] is not None or r["section_no"] in parents]


_SECTION = "section_no int, parent_no int, level int, section_order double, heading string, heading_key string, heading_path array<string>, page_start int, page_end int, text string"


def _emit(df: DataFrame, key: str, column: str, parse: Callable[[object], list[dict]], joiner: str) -> DataFrame:
    """Runs ``parse`` over one column of each row and returns its sections as rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in _SECTION.split(", "))]
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[column], strict=True):
                for r in parse(x) if x is not None else ():
                    text = joiner.join(r["body"])
                    rows.append((k, *(text if n == "text" else r[n] for n in names[1:])))
            out = pd.DataFrame(rows, columns=names)
            for c in ("parent_no", "page_start", "page_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {_SECTION}")


def _numbered_pages(text: str) -> list[tuple[int, str]]:
    """Pages of a text with their numbers; blank pages count."""
    return [(n, p) for n, p in enumerate(text.split("\f"), 1) if p.strip()]


def section_rows(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """The structured sections of each text; bodies are lines joined by one blank."""
    return _emit(df, key, text, lambda x: structured(_numbered_pages(x)), " ")


def raw_section_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """T08."""
    return _emit(df, key, text, raw_sections, " ")


def ordered_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pages): the pages of each file in order, one row per file (a file's pages are bounded by the file)."""
    return pages.where("text is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))


def page_section_rows(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """T09 over pages (key, page_number, text)."""
    return _emit(ordered_pages(pages, key), key, "pages", lambda ps: page_tree([(p["page_number"], p["text"]) for p in ps]), "\n")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def section_map(text: pd.Series, abstract: pd.Series) -> pd.Series:
    """The eight named sections that a text has; a given abstract wins; with none of them the text is the introduction."""
    names = sorted({a for v in SECTION_MAP.values() for a in v}, key=lambda x: (-len(x), x))
    heads = re.compile(r"(?im)^(?:\d+(?:\.\d+)*\s+)?(" + "|".join(names) + r")\s*$")

    def tidy(x: str | None) -> str | None:
        if x is None:
            return None
        x = re.sub(r"[ \t\f\v]+", " ", x.replace("\r\n", "\n").replace("\r", "\n"))
        return re.sub(r"\n{3,}", "\n\n", x).strip() or None

    def one(x: str | None, given: str | None) -> dict[str, str]:
        x = tidy(x)
        out = {"abstract": tidy(given)}
        found: dict[str, str] = {}
        marks = list(heads.finditer(x or ""))
        for m, nxt in zip(marks, [*marks[1:], None], strict=False):
            if body := tidy(x[m.end() : nxt.start() if nxt else len(x)]):
                found[m[1].casefold()] = body
        for name, aliases in SECTION_MAP.items():
            out[name] = out.get(name) or next((found[a] for a in aliases if a in found), None)
        if x and not any(out.values()):
            out["introduction"] = x
        return {k: v for k, v in out.items() if v}

    return pd.Series([one(x, a) for x, a in zip(text, abstract, strict=True)], dtype=object)


# --- Markdown -----------------------------------------------------------------------------------


def is_page_heading(c: Column) -> Column:
    """a line of page text that opens a section."""
    return (F.length(c) <= 180) & c.rlike(PAGE_HEADING)


def lines_to_markdown(ls: Column) -> Column:
    """Lines as headings and paragraphs, blocks parted by an empty line; a paragraph ends at a heading or an empty line."""
    heads = F.transform(ls, tx.heading_text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def close(a: Column) -> Column:
        p = tx.clean_pdf_text(a["open"])
        return F.when(p == "", a["done"]).otherwise(F.concat(a["done"], F.array(p, F.lit(""))))

    def step(a: Column, x: Column) -> Column:
        line = F.concat(F.repeat(F.lit("#"), tx.markdown_heading_level(x)), F.lit(" "), x)
        return (
            F.when(x == "", F.struct(close(a).alias("done"), F.lit("").alias("open")))
            .when(is_page_heading(x), F.struct(F.concat(close(a), F.array(line, F.lit(""))).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), F.when(a["open"] == "", x).otherwise(F.concat_ws(" ", a["open"], x)).alias("open")))
        )

    return F.aggregate(heads, start, step, close)


@F.pandas_udf(T.StringType())
def convert_headings(c: pd.Series) -> pd.Series:
    """Figure, table, numbered and common headings of a text become Markdown headings."""
    caption = re.compile(r"(?i)(?:(fig|figure)\.?|(table))\s+(\d+)\.?\s*(.*)$")

    def line(x: str) -> str:
        if m := caption.match(x):
            return f"### {'Figure' if m[1] else 'Table'} {m[3]}\n\n{m[4].strip()}"
        if m := re.match(r"(\d+(?:\.\d+){0,3})\.?\s+.+$", x):
            return "#" * min(2 + m[1].count("."), 4) + " " + x
        return "## " + x if re.sub("[^a-z0-9 ]+", "", x.casefold()).strip() in COMMON_HEADINGS else x

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out = re.sub(r"(?<=\w)-\n(?=\w)", "", "\n".join(line(x.strip()) for x in _line_end.split(text)))
        out = re.sub(r" *\n *", "\n", re.sub(r"[ \t\f\v]+", " ", out))
        return re.sub(r"\n{3,}", "\n\n", out).strip()

    return c.map(one)


# --- chunks -------------------------------------------------------------------------------------


def pack_context(c: Column, most: int) -> Column:
    """Paragraphs as they stand packed up to ``most`` characters; longer ones are sliced and close what is open."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["open"] == "", p).otherwise(tx.strip(F.concat(a["open"], F.lit("\n\n"), p)))
        flushed = F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        return (
            F.when(F.length(joined) <= most, F.struct(a["done"].alias("done"), joined.alias("open")))
            .when(F.length(p) > most, F.struct(F.concat(flushed, slices).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("open")))
        )

    return F.aggregate(F.split(c, "\n\n"), start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def context_room(limit: int, overhead: int, least: int = 1000, margin: int = 200) -> int:
    """Characters left for the corpus in a prompt of at most ``limit``; too little room is an error."""
    room = limit - overhead - margin
    if room < least:
        raise ValueError("prompt and vocabulary leave no room for the corpus")
    return room


def context_chunks(corpus: DataFrame, text: str, limit: int, overhead: int) -> DataFrame:
    """(chunk_no, chunk): the corpus whole if the prompt fits into ``limit``, else packed into the room left."""
    whole = F.length(text) + overhead <= limit
    longest = corpus.agg(F.max(F.length(text))).first()[0] or 0
    if longest + overhead <= limit:
        return corpus.select(F.lit(0).alias("chunk_no"), F.col(text).alias("chunk"))
    room = context_room(limit, overhead)
    return corpus.select(F.posexplode(F.when(whole, F.array(F.col(text))).otherwise(pack_context(F.col(text), room))).alias("chunk_no", "chunk"))


_paragraph = re.compile(r"\n\s*\n")
_TERM = re.compile("[A-Za-z][A-Za-z0-9-]{4,}")
#: Words that are no key terms of a page chunk.
NO_PAGE_TERMS = ("which", "there", "their", "these", "those", "using", "paper", "study")


def page_key_terms(text: str, most: int = 10) -> list[str]:
    """A04, page variant: most frequent words, ties by word, as first written."""
    seen: dict[str, list] = {}
    for w in _TERM.findall(text):
        seen.setdefault(w.casefold(), [0, w])[0] += 1
    ranked = sorted((k for k in seen if k not in NO_PAGE_TERMS), key=lambda k: (-seen[k][0], k))
    return [seen[k][1] for k in ranked[:most]]


def _label(paragraph: str) -> str:
    first = _line_end.split(paragraph, maxsplit=1)[0].strip()
    if m := re.match(r"#+\s+", first):
        return first[m.end() :]
    common = re.sub("[^a-z0-9 ]+", "", first.casefold()).strip() in COMMON_HEADINGS
    return first if common or re.match(r"\d+(?:\.\d+){0,3}\.?\s+", first) else ""


def chunks_of_pages(pages: list[tuple[int, str]], target: int = 1000, most: int = 1500) -> list[tuple]:
    """(section, page_start, page_end, text) packed over page borders; a chunk bears the newest heading read."""
    out: list[tuple] = []
    held: list[str] = []
    size, first, label = 0, None, "unknown"
    tokens = lambda chars: max(1, round(chars / 4))

    def emit(end: int | None) -> None:
        nonlocal held, size, first
        out.append((label, first, end, "\n\n".join(held)))
        held, size, first = [], 0, None

    for n, text in pages:
        for p in filter(None, map(str.strip, _paragraph.split(text))):
            label = _label(p) or label
            if held and tokens(size + 2 + len(p)) > most:
                emit(n)
            first = n if not held else first
            size += len(p) + (2 if held else 0)
            held.append(p)
            if tokens(size) >= target:
                emit(n)
    if held:
        emit(pages[-1][0])
    return out


def page_chunks(pages: DataFrame, key: str = "doc_id", target: int = 1000, most: int = 1500) -> DataFrame:
    """(key, chunk_no, section, page_start, page_end, approx_tokens, chunk_type, key_terms, text) of each file."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, i, s, a, e, t, page_key_terms(t))
                for k, ps in zip(b[key], b["pages"], strict=True)
                for i, (s, a, e, t) in enumerate(chunks_of_pages([(p["page_number"], p["text"]) for p in ps], target, most), 1)
            ]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "section", "page_start", "page_end", "text", "key_terms"])

    got = ordered_pages(pages, key).mapInPandas(run, f"{key} {kind}, chunk_no int, section string, page_start int, page_end int, text string, key_terms array<string>")
    return got.select(key, "chunk_no", "section", "page_start", "page_end", tx.tokens_by_chars("text").alias("approx_tokens"), tx.page_chunk_type("section").alias("chunk_type"), "key_terms", "text")


def page_provenance(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, page_number, char_count) of the filled pages of each text."""
    from .segments import pages

    return pages(df, key, text).select(key, "page_number", F.length(tx.whitespace_b("text")).alias("char_count"))


def paper_record(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, doi, lead_author_year, abstract) detected in a raw text, first as it is, then cleaned."""
    cleaned = df.select(key, F.col(text).alias("_raw"), tx.clean_extracted(text).alias("_clean"))
    both = lambda f: F.coalesce(f(F.col("_raw")), f(F.col("_clean")))
    names = F.when(F.size(tx.authors_from_text("_raw")) > 0, tx.authors_from_text("_raw")).otherwise(tx.authors_from_text("_clean"))
    lead = F.element_at(F.split(tx.strip(F.split_part(tx.strip(F.get(names, F.lit(0))), F.lit(","), F.lit(1))), r"\s+"), -1)
    facts = cleaned.select(key, tx.title_from_text("_raw").alias("title"), F.coalesce(both(tx.first_doi), F.lit("")).alias("doi"), F.concat_ws(", ", tx.empty_to_null(lead), both(tx.year_word)).alias("lead_author_year"), "_clean")
    abstract = raw_section_rows(cleaned, key, "_clean").where("heading_key = 'abstract'").groupBy(key).agg(F.min_by("text", "section_no").alias("abstract"))
    return facts.drop("_clean").join(abstract, key, "left").select(key, "title", "doi", "lead_author_year", F.coalesce("abstract", F.lit("")).alias("abstract"))
