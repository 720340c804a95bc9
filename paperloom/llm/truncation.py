"""Values that lost their end before they were stored, by prefix self-joins.

Every value is reduced to words in lower case with single blanks. Longer copies are looked for
 - in the row itself (citation, file name and path against title, title against file name),
 - in all rows by sorted order, at any length: what goes on after a value and agrees in author and
   year, or goes on within a word that stands nowhere else,
 - in all values by the last words: what always goes on there elsewhere lacks its end here.
A value at the longest length that an intake delivers, where lengths pile up, was cut by it unless a
copy shows its end. A mark in place of the end and a lost or cut file extension count; file names
that leave the title out are judged by their extension alone.

NULL and empty values are no cases; repeated rows are judged alike; NULL intakes report as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_on_unique
from ..session import cut_lineage

#: Words of context before the last word.
CONTEXT = 3
#: Values of one intake at its greatest length from which that length counts as its limit.
PILE, PILE_SHARE = 5, 0.01
EXTENSION = r"(?i)\.(?:pdf|md|txt|html?|docx?|epub|ps|djvu|rtf|tex|xml|tsv|csv)$"
MARK = r"(?:\.\.\.+|…|\[\.*\])\s*$"


def plain(c: Column) -> Column:
    """Lower-case words with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def longer(v: Column, w: Column) -> Column:
    """w goes on after v."""
    return F.coalesce((v != "") & w.startswith(v) & (F.length(w) > F.length(v)), F.lit(False))


def _title_in_name(stem: Column) -> Column:
    """The part of a file name that renders the title; NULL for styles without one."""
    dashed = F.regexp_extract(stem, r"^.+? - \d{4} - (.+)$", 1)
    spaced = F.regexp_extract(stem, r"^[^\d_]+? \d{4} (.+)$", 1)
    slug = F.regexp_extract(stem, r"^\d{4}[_ ][^_ ]+[_ ](.+)$", 1)
    joined = F.when(stem.rlike(r"^[^ ]+_[^ ]+_[^ ]+") | stem.rlike(r"^[^ ]+ [^ ]+ [^ ]+"), stem)
    n = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(n(dashed), n(spaced), n(slug), joined)


def _prepared(rows: DataFrame) -> DataFrame:
    path_name = F.regexp_extract(F.coalesce("pdf_path", F.lit("")), r"([^/\\]+)$", 1)
    has_ext = F.col("pdf_filename").rlike(EXTENSION)
    stem = F.regexp_replace(F.regexp_replace("pdf_filename", EXTENSION, ""), r"(?i)\.(?:p|pd)$", "")
    cited = F.regexp_extract(F.coalesce("citation", F.lit("")), r"\((?:\d{4}|n\.d\.)[^)]*\)\.?\s*(.+)$", 1)
    cited = F.regexp_replace(cited, r"\.\s+[^.]+\.?$", "")  # the journal after the title
    d = rows.select(
        "meta_id", "intake", "title", "pdf_filename", has_ext.alias("has_ext"), path_name.alias("path_name"),
        F.regexp_replace("title", MARK, "").alias("raw_t"), _title_in_name(stem).alias("raw_f"), plain(cited).alias("cited"),
        plain(F.concat_ws("|", "lead_author", "year")).alias("who"),
    )
    return d.withColumns({"t": plain(F.col("raw_t")), "f": F.coalesce(plain(F.col("raw_f")), F.lit("")), "lt": F.length("title"), "lf": F.length("raw_f")})


def _pile(d: DataFrame, length: str) -> DataFrame:
    """(intake, cap): the length that an intake cuts at, where its values pile up."""
    n = d.where(F.col(length).isNotNull()).groupBy("intake", length).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("intake").agg(F.max(F.struct(length, "n")).alias("m"), F.sum("n").alias("all"))
    return per.where((F.col("m.n") >= PILE) & (F.col("m.n") >= F.lit(PILE_SHARE) * F.col("all"))).select("intake", F.col(f"m.{length}").alias("cap"))


def kin(a: str, b: str) -> bool:
    """Author and year of two copies of a work: equal, or agreeing in an author's name and contradicting in nothing or little."""
    x, y = set(a.split()), set(b.split())
    return a == b or (any(t.isalpha() for t in x & y) and (x <= y or y <= x or len(x & y) > 1))


class _Chain:
    """The values read last that are prefixes of each other, in sorted order, with what goes on after them."""

    def __init__(self, rows: list[tuple[str, str]] = ()) -> None:  # rows: (v, who), sorted
        self.stack: list[tuple[str, dict[str, bool], list[bool]]] = []  # value, who: a copy goes on; [goes on within a word]
        for v, who in rows:
            self.add(v, who)

    def add(self, v: str, who: str) -> list[tuple]:
        """Takes the next row; returns what is known of the values that it does not go on after."""
        out = []
        while self.stack and not v.startswith(self.stack[-1][0]):
            out += self.pop()
        for u, whos, inside in self.stack:
            if u == v:
                continue
            inside[0] |= v[len(u)] != " "
            if not whos.get(who, False):
                for k in [k for k, hit in whos.items() if not hit and kin(k, who)]:
                    whos[k] = True
        if self.stack and self.stack[-1][0] == v:
            self.stack[-1][1].setdefault(who, False)
        else:
            self.stack.append((v, {who: False}, [False]))
        return out

    def pop(self) -> list[tuple]:
        v, whos, inside = self.stack.pop()
        return [(v, k, hit, inside[0]) for k, hit in whos.items() if hit or inside[0]]


def longer_copies(values: DataFrame) -> DataFrame:
    """(v, who, same, inside): the values after which another one goes on, in one of the same work or within a word.

    Values are sorted in ranges; a strict prefix stands directly before all that goes on after it. The
    prefixes of a range's last value are handed on to the next range.
    """
    rows = cut_lineage(values.distinct().repartitionByRange("v", "who").sortWithinPartitions("v", "who"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _Chain()
        for b in batches:
            for v, who in zip(b["v"], b["who"], strict=True):
                chain.add(v, who)
        left = [(TaskContext.get().partitionId(), v, who) for v, whos, _ in chain.stack for who in whos]
        yield pd.DataFrame(left, columns=["part", "v", "who"])

    handed: dict[int, list[tuple[str, str]]] = {}
    before: list[tuple[str, str]] = []
    last = sorted(tuple(r) for r in rows.mapInPandas(ends, "part int, v string, who string").collect())
    for part in range(rows.rdd.getNumPartitions()):
        handed[part] = before
        mine = [(v, who) for k, v, who in last if k == part]
        if mine:  # an element stays in the chain while the last value goes on after it
            before = sorted({*((v, who) for v, who in before if mine[-1][0].startswith(v)), *mine})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = _Chain(handed[TaskContext.get().partitionId()])
        for b in batches:
            out: list[tuple] = []
            for v, who in zip(b["v"], b["who"], strict=True):
                out += chain.add(v, who)
            yield pd.DataFrame(out, columns=["v", "who", "same", "inside"])
        out = []
        while chain.stack:
            out += chain.pop()
        yield pd.DataFrame(out, columns=["v", "who", "same", "inside"])

    found = rows.mapInPandas(run, "v string, who string, same boolean, inside boolean")
    return found.groupBy("v", "who").agg(F.bool_or("same").alias("same"), F.bool_or("inside").alias("inside"))


def _last_words(values: DataFrame) -> DataFrame:
    """(context, next, ends, goes_on) over all distinct values."""
    words = values.select(F.split("v", " ").alias("ws")).where(F.size("ws") > CONTEXT)
    at = F.sequence(F.lit(CONTEXT), F.size("ws") - 1)
    each = words.select(F.explode(F.transform(at, lambda i: F.struct(F.array_join(F.slice("ws", i - CONTEXT + 1, CONTEXT), " ").alias("context"), F.get("ws", i).alias("next"), (i == F.size("ws") - 1).alias("last")))).alias("x"))
    return each.groupBy("x.context", "x.next").agg(F.count_if("x.last").alias("ends"), F.count_if(~F.col("x.last")).alias("goes_on"))


def truncated(rows: DataFrame) -> DataFrame:
    """(meta_id, intake, field, reason) of every value that lacks its end.

    rows: meta_id, intake, title, citation, year, pdf_filename, pdf_path, lead_author.
    """
    d = cut_lineage(_prepared(rows))
    agree = (F.col("f") == F.col("t")) & ~F.col("title").rlike(MARK)  # two copies end alike
    whole_t = ((F.col("cited") != "") & (F.col("cited") == F.col("t"))) | agree
    own_t = longer(F.col("t"), F.col("cited")) | longer(F.col("t"), F.col("f"))
    own_f = longer(F.col("f"), F.col("t")) | longer(F.col("f"), F.col("cited"))
    whole_f = ((F.col("cited") != "") & (F.col("cited") == F.col("f"))) | agree
    t = d.where("title is not null and trim(title) <> ''").select(
        "meta_id", "intake", F.lit("title").alias("field"), F.col("t").alias("v"), F.col("lt").alias("size"), "who",
        F.when(F.col("title").rlike(MARK), "mark").when(own_t, "own row").when(whole_t, "").alias("reason"),
    )
    lost_ext = ~F.col("has_ext")
    path_more = longer(F.lower("pdf_filename"), F.lower("path_name"))
    f = d.where("pdf_filename is not null and trim(pdf_filename) <> ''").select(
        "meta_id", "intake", F.lit("pdf_filename").alias("field"), F.col("f").alias("v"), F.col("lf").alias("size"), "who",
        F.when(lost_ext, "extension").when(path_more, "path").when(F.regexp_replace("pdf_filename", EXTENSION, "").rlike(MARK), "mark")
        .when(F.col("raw_f").isNull(), "").when(own_f, "own row").when(whole_f, "").alias("reason"),
    )
    both = t.unionByName(f)
    judged = both.where("reason is not null").where("reason <> ''").select("meta_id", "intake", "field", "reason")
    open_ = both.where("reason is null and v <> ''")

    values = d.select(F.explode(F.array_distinct(F.array("t", "f", "cited"))).alias("v"), "who").where("v <> ''")
    # what goes on within a word is cut if that word stands nowhere else
    found = cut_lineage(longer_copies(values).withColumn("p", F.element_at(F.split("v", " "), -1)))
    inner = values.select(F.explode(F.split("v", " ")).alias("p"), "v").where(~F.endswith("v", F.concat(F.lit(" "), "p")) & (F.col("v") != F.col("p"))).select("p").distinct()
    copies = found.where("same").unionByName(found.where("inside and not same").join(inner, "p", "left_anti")).select("v", "who")
    uses = open_.groupBy("v", "who").agg(F.count(F.lit(1)).alias("n")).join(copies, ["v", "who"]).select(F.to_json(F.array("v", "who")).alias("work"), "n")
    seen = join_on_unique(open_.withColumn("work", F.to_json(F.array("v", "who"))), uses, "work", "n").select("meta_id", "field").distinct()
    by_copy = open_.join(seen, ["meta_id", "field"], "left_semi").select("meta_id", "intake", "field", F.lit("copy").alias("reason"))

    rest = cut_lineage(open_.join(seen, ["meta_id", "field"], "left_anti"))
    ws = F.split("v", " ")
    asked = rest.where(F.size(ws) > CONTEXT).select("meta_id", "intake", "field", F.array_join(F.slice(ws, F.size(ws) - CONTEXT, CONTEXT), " ").alias("context"), F.element_at(ws, -1).alias("p"))
    stats = cut_lineage(_last_words(values.select("v").distinct()))
    need = asked.groupBy("context", "p").agg(F.count(F.lit(1)).alias("asked"))  # hot endings are asked once
    same = F.col("next") == F.col("p")
    answer = need.join(stats, "context").groupBy("context", "p").agg(
        F.sum(F.when(same, F.col("ends")).otherwise(0)).alias("ends"), F.sum(F.when(same, F.col("goes_on")).otherwise(0)).alias("goes_on"),
        F.sum(F.when(F.col("next").startswith(F.col("p")) & ~same, F.col("ends") + F.col("goes_on")).otherwise(0)).alias("more"), F.first("asked").alias("asked"),
    )
    mid_word = (F.col("more") >= 2) & (F.col("ends") + F.col("goes_on") <= 0.2 * F.col("more") + 1)
    goes_on = (F.col("goes_on") >= 4) & (F.col("ends") <= 0.15 * F.col("goes_on") + 1) & (F.col("word_ends") <= 0.02 * F.col("word_goes_on"))
    by_word = stats.groupBy(F.col("next").alias("p")).agg(F.sum("ends").alias("word_ends"), F.sum("goes_on").alias("word_goes_on"))
    cut = answer.join(by_word, "p", "left").where(mid_word | goes_on).withColumn("ending", F.concat_ws("|", "context", "p")).select("ending", "asked")
    by_ending = join_on_unique(asked.withColumn("ending", F.concat_ws("|", "context", "p")), cut, "ending", "asked").select("meta_id", "intake", "field", F.lit("ending").alias("reason"))

    caps = F.broadcast(_pile(t, "size").withColumn("field", F.lit("title")).unionByName(_pile(f.where("reason is null or reason = 'own row'"), "size").withColumn("field", F.lit("pdf_filename"))))  # one row per intake
    by_cap = rest.alias("r").join(caps.alias("c"), F.expr("r.intake <=> c.intake and r.field = c.field and r.size = c.cap")).select("meta_id", "r.intake", "r.field", F.lit("limit").alias("reason"))
    late = by_ending.unionByName(by_cap).groupBy("meta_id", "field").agg(F.first("intake").alias("intake"), F.min("reason").alias("reason"))
    return judged.unionByName(by_copy).unionByName(late.select("meta_id", "intake", "field", "reason"))


def rates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(intake, field, values, truncated, rate) of every intake."""
    kept = rows.select("intake", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("v")), F.struct(F.lit("pdf_filename").alias("field"), F.col("pdf_filename").alias("v")))).alias("x"))
    kept = kept.where("x.v is not null and trim(x.v) <> ''").groupBy("intake", "x.field").agg(F.count(F.lit(1)).alias("values"))
    n = found.groupBy("intake", "field").agg(F.count(F.lit(1)).alias("truncated"))
    k, m = kept.alias("k"), n.alias("m")
    out = k.join(m, F.expr("k.intake <=> m.intake and k.field = m.field"), "left")
    return out.select("k.intake", "k.field", "values", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("values")).alias("rate"))
