"""Freely written labels mapped to the entries of a reference list, by token-level repair.

1. Labels are reduced to distinct spellings, these to distinct tokens.
2. Each distinct token is joined to the reference vocabulary by edit distance: symmetric deletion
   keys find the pairs, an exact distance confirms them. Plurals and abbreviations (a full stop
   after the start of a word) are repairs too.
3. Soft TF-IDF over the repaired tokens ranks complete entries (labels and synonyms). An entry is
   accepted only if all its tokens and all tokens of the label are paired, apart from qualifiers
   that name nothing; sharing some words is not enough. Since every token must be paired, entries
   are looked up by the label's rarest token alone. One token may stand for two
   neighbours of an entry. Labels written without blanks are compared with entries written without
   blanks by keys of one deletion, so of two edits there only those that share such a key are found.

NULL labels and labels without letters are unmatched; entries that are NULL or empty are skipped; a
tie between different terms goes to the smaller distance, then to the smaller term id.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import join_on_unique
from ..session import cut_lineage

#: Qualifiers at the start or the end of a label that do not change what it means.
LEADING = ("the", "a", "an", "observed")
TRAILING = ("n.o.s.", "of the sample", "(measured)", ", mean value")
#: Greek letters written out.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega", "ζ": "zeta"}
#: Tokens of an entry up to which all ways to join neighbours are forms of it (233 for 12).
MANY = 12

_units = re.compile(r"\[[^\]]*\]\s*$")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_initials = re.compile(r"\b(?:\w\.){2,}")
_token = re.compile(r"[^\W_]+\.?")


def tokens(label: str | None) -> list[str]:
    """Lower-case tokens of the core of a label; possible abbreviations keep their full stop."""
    if not label:
        return []
    s = unicodedata.normalize("NFKC", label)
    s = re.sub(r"[{}]", "", s)
    s = re.sub(r"^[\W_]*[•*][\W_]*|^[\W_]+(?=\w)", "", s)
    if " " not in s.strip():
        s = _camel.sub(" ", s)
    s = " ".join(re.sub(r"_", " ", s.lower()).split())
    s = "".join(GREEK.get(c, c) for c in s)
    before = None
    while before != s:
        before = s
        s = _units.sub("", s).strip(" \"'“”«»!;:*,-–—")
        for t in TRAILING:
            if s.endswith(t):
                s = s[: -len(t)]
        first, _, rest = s.partition(" ")
        if rest and first in LEADING:
            s = rest
    s = _initials.sub(lambda m: m[0].replace(".", "") + " ", s)
    return _token.findall(s)


def squashed(label: str | None) -> str:
    return "".join(t.rstrip(".") for t in tokens(label))


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >= 1 << 63 else h


def deletions(w: str, depth: int) -> set[str]:
    out = {w}
    ring = {w}
    for _ in range(depth):
        ring = {x[:i] + x[i + 1 :] for x in ring for i in range(len(x))}
        out |= ring
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i]
        for j in range(1, len(b) + 1):
            c = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, prev2[j - 2] + 1)
            cur.append(c)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


def allowed(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 0 if min(len(a), len(b)) < 3 else 1 if n <= 4 else 2


def singular(w: str) -> str:
    return w[:-3] + "y" if w.endswith("ies") and len(w) > 5 else w[:-1] if w.endswith("s") and len(w) > 4 else w


def token_keys(w: str, entry: bool) -> list[int]:
    """Join keys of a token; vocabulary tokens have their prefixes as well."""
    bare = w.rstrip(".")
    keys = deletions(bare, 0 if len(bare) < 3 else 1 if len(bare) < 5 else 2)
    if entry:
        keys |= {bare[:k] + "…" for k in range(3, len(bare))}
    else:
        if w.endswith(".") and len(bare) >= 3:
            keys.add(bare + "…")
        keys.add(singular(bare))
    return [_hash(k) for k in keys]


def similarity(w: str, v: str) -> float:
    """1 for equal tokens, less for repairs, 0 for none."""
    bare = w.rstrip(".")
    if bare == v:
        return 1.0
    if singular(bare) == v or singular(v) == bare:
        return 0.98
    best = 0.0
    if w.endswith(".") and len(bare) >= 3 and v.startswith(bare):
        best = 0.9
    d = distance(bare, v, allowed(bare, v))
    if d <= allowed(bare, v):
        best = max(best, 1.0 - d / max(len(bare), len(v)) - 0.05 * (bare[0] != v[0]))
    return best


def _explode_keys(entry: bool, depth: int | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["key"] = [token_keys(w, entry) if depth is None else [_hash(k) for k in deletions(w, depth)] for w in b["w"]]
            yield b

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of which each is worth a distance, over all cores: they are small, so their number must not be judged by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def repairs(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, reps: array of (v, sim, n)) for the distinct ``words.w`` against ``vocabulary`` (w, n).

    An exact hit excludes other repairs.
    """
    a = words.select("w").mapInPandas(_explode_keys(False), "w string, key array<long>").select("w", F.explode("key").alias("key"))
    b = vocabulary.select("w", "n").mapInPandas(_explode_keys(True), "w string, n long, key array<long>").select(F.col("w").alias("v"), "n", F.explode("key").alias("key"))

    sim = F.pandas_udf(lambda w, v: pd.Series([similarity(x, y) for x, y in zip(w, v, strict=True)]), T.DoubleType())
    pairs = _spread(a.join(b, "key").select("w", "v", "n").distinct(), "w", "v").withColumn("sim", sim("w", "v")).where("sim > 0.6")
    reps = pairs.groupBy("w").agg(F.collect_list(F.struct("v", "sim", "n")).alias("reps"))
    exact = F.filter("reps", lambda r: r["sim"] >= 0.97)
    return reps.select(F.col("w").alias("token"), F.when(F.size(exact) > 0, exact).otherwise(F.col("reps")).alias("reps"))




def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["toks"] = b["name"].map(tokens)
        b["squash"] = b["toks"].map(lambda t: "".join(x.rstrip(".") for x in t))
        yield b


def _entry_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["toks"] = b["name"].map(lambda s: [t.rstrip(".") for t in tokens(s)])
        b["squash"] = b["toks"].map("".join)
        yield b


def merged(toks: list[str]) -> list[list[str]]:
    """The tokens, and all ways to write neighbouring pairs of them as one word; beyond MANY tokens one pair at a time."""
    if len(toks) > MANY:
        return [toks, *(toks[:k] + [toks[k] + toks[k + 1]] + toks[k + 2 :] for k in range(len(toks) - 1))]
    ways: list[list[list[str]]] = [[[]], [toks[:1]]]
    for k in range(2, len(toks) + 1):
        ways.append([w + [toks[k - 1]] for w in ways[k - 1]] + [w + [toks[k - 2] + toks[k - 1]] for w in ways[k - 2]])
    return ways[-1]


def _entry_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(e, t, n, w) for e, t, n, toks in zip(b["entry"], b["term_id"], b["name"], b["toks"], strict=True) for w in merged(list(toks))]
        yield pd.DataFrame(rows, columns=["entry", "term_id", "matched_name", "toks"])


def _pairing(label: list[tuple[str, dict[str, float]]], entry: list[str], idf: dict[str, float]) -> float:
    """Soft TF-IDF of a full one-to-one pairing, 0 if a token of either side is left over."""
    if len(label) != len(entry):
        return 0.0
    free = list(entry)
    num = a = b = 0.0
    for _, reps in sorted(label, key=lambda x: (len(x[1]), -max(x[1].values()))):
        at = max((v for v in free if v in reps), key=lambda v: reps[v], default=None)
        if at is None:
            return 0.0
        free.remove(at)
        w = idf[at]
        num += w * w * reps[at]
        a += w * w
        b += w * w
    return num / math.sqrt(a * b) if a else 0.0


def map_labels(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(label, term_id, matched_name, score) for the distinct ``labels.label`` that mean a term.

    ``terms``: term_id, label, synonyms. Both sides may be large: all steps are joins on tokens.
    """
    names = terms.select("term_id", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("label"))).alias("name"))
    names = names.where("trim(name) <> '' and term_id is not null").distinct()
    entries = cut_lineage(names.mapInPandas(_entry_names, "term_id string, name string, toks array<string>, squash string").where("size(toks) > 0").withColumn("entry", F.xxhash64("term_id", "name")))
    # one token of a label may stand for two neighbours of an entry
    forms = entries.mapInPandas(_entry_forms, "entry long, term_id string, matched_name string, toks array<string>")
    forms = cut_lineage(forms.withColumn("form", F.xxhash64("entry", "toks")))
    postings = forms.select("entry", "form", F.size("toks").alias("size"), F.explode(F.array_distinct("toks")).alias("w"))
    vocabulary = postings.select("w", "entry").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n_entries = entries.count()

    spelled = labels.select(F.col("label").alias("name")).where("name is not null").distinct()
    spelled = cut_lineage(spelled.mapInPandas(_tokenised, "name string, toks array<string>, squash string").where("size(toks) > 0"))
    each = spelled.select("name", F.size("toks").alias("size"), F.posexplode("toks").alias("pos", "token"))
    words = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    fixed = repairs(words.select(F.col("token").alias("w")), vocabulary)
    fixed = cut_lineage(fixed.join(words, "token"))
    placed = join_on_unique(each, fixed, "token", "uses").groupBy("name", "size").agg(F.collect_list(F.struct(F.aggregate("reps", F.lit(0).cast("long"), lambda x, r: x + r["n"]).alias("total"), "pos", "token", "reps")).alias("found"))
    placed = placed.where(F.size("found") == F.col("size"))
    rarest = F.array_min(F.transform("found", lambda x: F.struct(x["total"].alias("total"), x["pos"].alias("pos"), x["reps"].alias("reps"))))
    looked = placed.select("name", "found", F.explode(rarest["reps"]).alias("r")).select("name", "found", F.col("r.v").alias("w"))
    # postings are rows; only forms of as many tokens as the label are met
    hits = looked.withColumn("size", F.size("found")).join(postings.select("w", "size", "form"), ["w", "size"]).select("name", "found", "form")
    # every label token carries its repairs, so the entry's tokens are all that is joined
    hits = hits.join(forms.select("form", "term_id", "matched_name", "toks"), "form")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, found, term, m, toks in zip(b["name"], b["found"], b["term_id"], b["matched_name"], b["toks"], strict=True):
                if len(found) != len(toks):
                    continue
                idf = {r["v"]: math.log(1 + n_entries / r["n"]) for f in found for r in f["reps"]}
                s = _pairing([(f["token"], {r["v"]: r["sim"] for r in f["reps"]}) for f in found], list(toks), idf)
                if s > 0:
                    rows.append((name, term, m, s))
            yield pd.DataFrame(rows, columns=["label", "term_id", "matched_name", "score"])

    out = "label string, term_id string, matched_name string, score double"
    by_tokens = hits.mapInPandas(score, out)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        s = df.select(F.col("squash").alias("w")).where("w <> ''").distinct()
        return s.mapInPandas(_explode_keys(False, 1), "w string, key array<long>").select(F.col("w").alias(name), F.explode("key").alias("key"))

    # distinct spellings without blanks are compared, of any number of tokens
    far = F.pandas_udf(lambda a, b: pd.Series([1 - d / len(x) if (d := distance(x, y, 2)) <= 2 else 0.0 for x, y in zip(a, b, strict=True)]), T.DoubleType())
    blanks = _spread(keyed(spelled, "a").join(keyed(entries, "b"), "key").select("a", "b").distinct(), "a", "b")
    blanks = blanks.withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(far("a", "b")) - 0.01).where("score > 0.8")
    blanks = blanks.join(entries.select(F.col("squash").alias("b"), "term_id", F.col("name").alias("matched_name")), "b").join(spelled.select("name", F.col("squash").alias("a")), "a")
    both = by_tokens.unionByName(blanks.select(F.col("name").alias("label"), "term_id", "matched_name", "score"))
    best = both.groupBy("label").agg(F.max(F.struct("score", F.col("matched_name"), "term_id")).alias("b"))
    return best.select("label", "b.term_id", "b.matched_name", "b.score")


def map_rows(rows: DataFrame, terms: DataFrame, ident: str = "id") -> DataFrame:
    """(id, label, term_id, matched_name, score) of every row; unmatched rows have NULLs."""
    narrow = rows.select(F.col(ident).alias("id"), "label")
    uses = narrow.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("uses"))
    mapped = cut_lineage(map_labels(narrow, terms).join(uses, "label"))
    got = join_on_unique(narrow, mapped, "label", "uses").drop("uses")
    rest = narrow.join(got.select("id"), "id", "left_anti")
    return got.select("id", "label", "term_id", "matched_name", "score").unionByName(rest, allowMissingColumns=True)


def mapped_rows(rows: DataFrame, terms: DataFrame, ident: str = "id") -> DataFrame:
    """(id, term_id) of the rows whose label means a term."""
    narrow = rows.select(F.col(ident).alias("id"), "label")
    uses = narrow.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("uses"))
    mapped = cut_lineage(map_labels(narrow, terms).join(uses, "label"))
    return join_on_unique(narrow, mapped, "label", "uses").select("id", "term_id")
