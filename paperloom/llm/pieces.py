"""Oversized items cut at natural boundaries, by structure-tree packing.

A text is a tree: headings by their depth, then paragraphs, list items, lines, sentences, words. Nodes
that fit are leaves; only oversized nodes are descended into. Packing goes bottom-up: the pieces of a
node's children are merged with their neighbours while they fit, the remainders of a descended child
with its siblings included, so that in the end no two neighbouring pieces fit together. Signs of a heading inside a code fence are none, and a
fence is not cut at its blank lines before its lines. A piece after the first repeats about ``overlap``
characters of the one before it, starting at a word. The bodies of the pieces (without overlap)
concatenate to the text.

NULL and empty texts give no piece; a text within the limit is one piece; limits <= 0 and NULL
limits leave the text whole. Extra columns are ignored; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_heading = re.compile(
    r"(?m)^(?:(#{1,6})[ \t]+\S.*|(\d{1,2}(?:\.\d{1,2})*)\.?[ \t]+[A-Z][^\n.!?]{0,100}|[ \t]*<[hH]([1-6])\b[^\n]*|(?=\S)[^\n]{1,120}\n(={3,})[ \t]*)$"
)
_fence = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
#: From coarse to fine: blank lines, list items, lines, sentence ends, white space.
_levels = [
    ("paragraph", re.compile(r"\n[ \t\r\f\v]*\n\s*")),
    ("list item", re.compile(r"\n(?=[ \t]*(?:[-*•]|\d{1,3}[.)])[ \t])")),
    ("line", re.compile(r"\r\n?|\n|\f")),
    ("sentence", re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*\s+")),
    ("word", re.compile(r"\s+|[\u200b]")),
]
Span = tuple[int, int]


class _Tree:
    """The tree of one text, built where it is descended into."""

    def __init__(self, text: str, limit: int) -> None:
        self.text, self.limit = text, limit
        self.fences = [m.span() for m in _fence.finditer(text)] if "```" in text or "~~~" in text else []
        marks = ((m.start(), len(m[1]) if m[1] else m[2].count(".") + 1 if m[2] else int(m[3]) if m[3] else 1) for m in _heading.finditer(text))
        self.heads = [(p, d) for p, d in marks if not self.fenced(p)]

    def fenced(self, at: int) -> bool:
        return any(a <= at < b for a, b in self.fences)

    def sections(self, s: int, e: int, depth: int) -> tuple[list[Span], int]:
        """The children of a section: parts before its shallowest deeper headings; the depth of these."""
        inner = [(p, d) for p, d in self.heads[bisect_left(self.heads, (s, 0)) : bisect_left(self.heads, (e, 0))] if d > depth]
        if not inner:
            return [], depth
        top = min(d for _, d in inner)
        cuts = sorted({s, *(p for p, d in inner if d == top)})
        return list(zip(cuts, [*cuts[1:], e], strict=True)), top

    def parts(self, s: int, e: int, level: int) -> list[Span]:
        """The children of a node below the headings: parts between the marks of a level."""
        spans, at = [], s
        for m in _levels[level][1].finditer(self.text, s, e):
            if s < m.end() < e and m.end() > at and not (level < 2 and self.fenced(m.start())):
                spans.append((at, m.end()))
                at = m.end()
        return [*spans, (at, e)]

    def merged(self, pieces: list[Span]) -> list[Span]:
        """Neighbours joined from the left while they fit."""
        out: list[Span] = []
        for s, e in pieces:
            if out and e - out[-1][0] <= self.limit:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
        return out

    def packed(self, s: int, e: int, depth: int = 0, level: int = 0) -> list[Span]:
        """Pieces of a node: itself if it fits, else its children's pieces, merged."""
        if e - s <= self.limit:
            return [(s, e)]
        if level == 0:
            kids, below = self.sections(s, e, depth)
            if kids and (len(kids) > 1 or below > depth):
                return self.merged([p for a, b in kids for p in self.packed(a, b, below, 0)])
        while level < len(_levels):
            kids = self.parts(s, e, level)
            level += 1
            if len(kids) > 1:
                return self.merged([p for a, b in kids for p in self.packed(a, b, depth, level)])
        return [(i, min(i + self.limit, e)) for i in range(s, e, self.limit)]


def _boundary(text: str, at: int, starts: set[int]) -> str:
    if at == 0:
        return "start"
    if at in starts:
        return "heading"
    tail = text[max(0, at - 80) : at]
    gap = tail[len(tail.rstrip()) :]
    if gap.count("\n") > 1:
        return "paragraph"
    if "\n" in gap or "\f" in gap or "\r" in gap:
        return "line"
    if gap:
        return "sentence" if tail.rstrip()[-1:] in ".!?。！？…\"'”’)" else "word"
    return "character"


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start of the piece, start of its body, end, boundary before the body) in order."""
    if len(text) <= limit or limit <= 0:
        return [(0, 0, len(text), "start")]
    overlap = max(0, min(overlap, limit // 2))
    tree = _Tree(text, limit - overlap)
    starts = {p for p, _ in tree.heads}
    out = []
    for s, e in tree.packed(0, len(text)):
        lead = max(0, s - overlap)
        if lead and not text[lead - 1].isspace():  # begin the overlap at a word
            m = re.compile(r"\s\S").search(text, lead, s)
            lead = m.end() - 1 if m else lead
        out.append((lead, s, e, _boundary(text, s, starts)))
    return out


_PIECE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("start", "body_start", "stop")), T.StructField("boundary", T.StringType()), T.StructField("piece", T.StringType())])


@F.pandas_udf(T.ArrayType(_PIECE))
def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    def one(x: str | None, most: int, shared: int) -> list[dict] | None:
        return None if x is None else [{"start": a, "body_start": s, "stop": e, "boundary": w, "piece": x[a:e]} for a, s, e, w in cut(x, int(most), int(shared))]

    return pd.Series([one(x, m, o) for x, m, o in zip(text, limit, overlap, strict=True)], dtype=object)


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of ``items`` (item_table, item_id, text) under the limits (item_table, max_size, overlap).

    The limits are a small fixed table. One scan; only oversized texts go to Python.
    """
    sized = items.where(F.length("text") > 0).join(F.broadcast(limits), "item_table", "left")
    over = F.coalesce(F.length("text") > F.col("max_size"), F.lit(False)) & (F.col("max_size") > 0)
    cuts = _pieces(F.when(over, F.col("text")), F.coalesce("max_size", F.lit(0)), F.coalesce("overlap", F.lit(0)))
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("start"), zero.alias("body_start"), F.length("text").cast("long").alias("stop"), F.lit("start").alias("boundary"), F.col("text").alias("piece")))
    rows = sized.withColumn("c", cuts).withColumn("c", F.coalesce("c", whole)).select("item_table", "item_id", F.size("c").alias("pieces"), F.posexplode("c").alias("n", "p"))
    return rows.select("item_table", "item_id", (F.col("n") + 1).alias("piece_no"), "pieces", "p.*")


def oversized_found(pieces: DataFrame) -> DataFrame:
    """One row per item that was cut: each has exactly one second piece."""
    return pieces.where("piece_no = 2").select("item_table", "item_id")
