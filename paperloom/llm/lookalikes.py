"""One consistent form for texts that print alike, by transitive look-alike classes.

1. The code points of all texts are counted (a table no longer than Unicode itself).
2. Union-find over code points and strings joins what prints alike: width variants, ligatures and
   other compatibility signs with the letters they show, blanks of one space, hyphens, letters of
   other alphabets drawn with the same shape. A class with a string of several characters is
   represented by that string, any other by its most frequent code point in the corpus.
3. Each text is decomposed, rewritten greedily (leftmost longest) by one automaton over all
   patterns, and composed again. Signs without ink map to ''.

Raised or lowered digits, fractions, letter case, accents and different words stay different.
NULL texts stay NULL and pair with nothing; empty texts and texts of inkless signs only are equal
to each other; repeated rows are copies and pair only with different texts of the same form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_on_unique
from ..session import cut_lineage

#: Characters drawn alike in common fonts; each line is one class.
LOOKALIKES = """
A А Α Ꭺ ꓮ
B В Β Ᏼ ꓐ
C С Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F ꓝ
G Ꮐ ꓖ
H Н Η Ꮋ ꓧ
I І Ι
J Ј Ꭻ ꓙ
K К Κ Ꮶ ꓗ
L Ꮮ ꓡ
M М Μ Ꮇ ꓟ
N Ν ꓠ
O О Ο Օ ꓳ
P Р Ρ Ꮲ ꓑ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ꭲ ꓔ
U Ս ꓴ
V Ꮩ ꓦ
W Ꮃ ꓪ
X Х Χ ꓫ
Y Υ Ү ꓬ
Z Ζ Ꮓ ꓜ
a а
c с ϲ
d ԁ
e е
g ց
h һ հ
i і
j ј
l ӏ
n ո
o о ο օ
p р
q ԛ զ
s ѕ
u ս
v ν ѵ
w ԝ
x х
y у
Γ Г
Δ ∆
Π П ∏
Φ Ф
Σ ∑
- ‐ ‑
’ ʼ
· ∙ ⋅
"""
#: Decomposition kinds whose sign prints like its parts.
SAME_PRINT = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Compatibility signs whose print differs from their parts.
NOT_SAME = "ſ№ϒϰϱϵϴϕϑϐϖ℀℁℅℆™℠℡"


def is_inkless(ch: str) -> bool:
    """Format and control characters, variation selectors, fillers."""
    c = ord(ch)
    return (
        (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\v\f\x85")
        or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF
        or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
    )


def _shown_as(ch: str) -> str | None:
    """The string that a single sign prints like, by the character database."""
    if unicodedata.category(ch) == "Zs":
        return " "
    kind, _, parts = unicodedata.decomposition(ch).partition(" ")
    if kind not in SAME_PRINT or ch in NOT_SAME:
        return None
    s = "".join(chr(int(p, 16)) for p in parts.split())
    return None if s[:1] == " " else s  # spacing accents


class _Classes:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)


def lookalike_rewrites(counts: dict[str, int]) -> dict[str, str]:
    """pattern -> representative for the observed code points; identities are left out."""
    classes = _Classes()
    seen = set(counts)
    table = [line.split() for line in LOOKALIKES.strip().splitlines()]
    tabled = {ch for line in table for ch in line}
    for line in table:
        for ch in line[1:]:
            classes.union(line[0], ch)
    for ch in list(seen):
        parts = unicodedata.normalize("NFD", ch)
        seen.update(parts)
        if ch not in tabled and (s := _shown_as(ch)):
            classes.union(ch, unicodedata.normalize("NFD", s))
            seen.update(unicodedata.normalize("NFD", s))
    members: dict[str, list[str]] = {}
    for x in list(classes.up):
        members.setdefault(classes.find(x), []).append(x)
    out: dict[str, str] = {ch: "" for ch in seen if is_inkless(ch)}
    for m in members.values():
        rep = max(m, key=lambda x: (len(x), counts.get(x, 0), -ord(x[0])))
        out.update({x: rep for x in m if x != rep and (x in seen or len(x) > 1)})
    for x, rep in list(out.items()):  # the letters of a string have representatives of their own
        new = "".join(out.get(ch, ch) if len(rep) > 1 else ch for ch in rep)
        out[x] = new
    return {x: r for x, r in out.items() if x != r}


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0x110000, dtype=np.int64)
    for b in batches:
        raw = "".join(x for x in b.iloc[:, 0] if x is not None).encode("utf-32-le", "surrogatepass")
        if raw:
            n = np.bincount(np.frombuffer(raw, dtype=np.uint32))
            total[: len(n)] += n
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"code_point": at.astype("int32"), "n": total[at]})


def code_point_counts(texts: DataFrame) -> DataFrame:
    """(code_point, n) over all texts; each task sends at most one row per code point."""
    return texts.mapInPandas(_count_batches, "code_point int, n long").groupBy("code_point").agg(F.sum("n").alias("n"))


class Rewriter:
    """Rewrites texts by one automaton over all patterns; built once per worker."""

    def __init__(self, rewrites: dict[str, str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x, r in rewrites.items():
            self.automaton.add_word(x, (len(x), r))
        self.ready = bool(rewrites)
        if self.ready:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if text is None or not self.ready:
            return text
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (n, r) in self.automaton.iter_long(text):
            start = end - n + 1
            if start > at:
                out.append(text[at:start])
            out.append(r)
            at = end + 1
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


def look_alike_map(texts: DataFrame) -> dict[str, str]:
    """The rewrites for a corpus. What reaches the driver is bounded by the size of Unicode."""
    return lookalike_rewrites({chr(r.code_point): r.n for r in code_point_counts(texts).collect()})


def consistent_form(docs: DataFrame, text: str = "text", form: str = "form", rewrites: dict[str, str] | None = None) -> DataFrame:
    """docs with the consistent form of ``text`` in a new column ``form``.

    Texts of ASCII characters that no rewrite touches stay in the JVM.
    """
    rewrites = look_alike_map(docs.select(text)) if rewrites is None else rewrites
    touched = "".join(sorted({c for x in rewrites for c in x if c.isascii() and c.isprintable()}))
    multi = any(len(x) > 1 and x.isascii() for x in rewrites)
    plain = F.col(text).isNull() | ~F.col(text).rlike(r"[^\t\n\x0B\f\r -~]")
    if touched and not multi:
        plain = plain & (F.coalesce(F.length(F.translate(F.col(text), touched, "")) == F.length(text), F.lit(True)))
    elif multi:
        plain = F.col(text).isNull()

    def rewrite(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(rewrites)
        for b in batches:
            b[form] = b[text].map(rw)
            yield b

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(form, T.StringType())])
    return docs.where(plain).withColumn(form, F.col(text)).unionByName(docs.where(~plain).mapInPandas(rewrite, schema))


#: Rows of a class that one task pairs with the whole class.
BLOCK = 2000


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, t, k): digests of each text and of its consistent form; the texts are rewritten once and stop here."""
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    digest = lambda c: F.md5(F.to_binary(c, F.lit("utf-8")))
    return cut_lineage(consistent_form(narrow).select("id", digest("text").alias("t"), digest("form").alias("k")))


def alike_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, texts, members): the class of every text that prints like another one, by its smallest id.

    One row per document, however large a class is; partial counts of each (class, text) come first.
    """
    keyed = _keyed(docs, ident, text)
    per_text = keyed.groupBy("k", "t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    per = per_text.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members")).where("texts > 1")
    return join_on_unique(keyed, per, "k", "members").select(F.col("id").alias(ident), "class_id", "texts", "members")


def alike_pairs(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): every pair whose texts print alike but differ, smaller id first.

    Only classes with at least two different texts are paired; a large class is spread over
    blocks of its rows, so that no task holds more than BLOCK rows against it.
    """
    keyed = _keyed(docs, ident, text)
    mixed = (
        keyed.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("k", "n")
    )
    rows = join_on_unique(keyed, mixed, "k", "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    a = rows.select("k", F.col("id").alias("doc_id_a"), F.col("t").alias("ta"), F.expr("pmod(xxhash64(id), blocks)").cast("int").alias("block"))
    b = rows.select("k", F.col("id").alias("doc_id_b"), F.col("t").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["k", "block"]).where("doc_id_a < doc_id_b and ta <> tb").select("doc_id_a", "doc_id_b")
