"""Texts of scanned pages repaired into continuous paragraphs.

1. A corpus lexicon is counted over all texts (partial counts per task). Its frequent words, by
   share of all words, are the trusted targets; a share bounds their number, whatever the corpus.
2. Per text: running headers, footers and page numbers are lines at page edges, or lines that
   interrupt a paragraph at a page break, which the line filling does not explain; words divided at
   a line end are joined unless the lexicon knows the compound with its hyphen.
3. Misread words: candidates are the trusted words that confusion pairs make of a word (any number of pairs that the weighted
   distance accepts, found by a walk over prefixes) and those at one other edit (found by a symmetric-deletion
   index). The weighted distance counts confusion pairs least, then swaps, then other edits. A repair by confusion
   pairs alone is decided by distance and frequency, neighbours breaking ties; any other edit also needs a
   neighbour that often stands beside the repair, and never changes just the ending of a word.

NULL and empty texts have no noise and stay as they are; repeated rows are judged alike; a text of
headers only becomes empty.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

#: Least share of all words, and least count, of a trusted word (at most 1/share words are trusted).
SHARE, LEAST = 1e-5, 8
#: A misread word is at least so many times rarer than its repair.
RATIO = 10
#: Misreading and the characters meant.
CONFUSIONS = """
1 l, 1 i, ! i, ! l, | l, | i, l i, i l, l t, 0 o, 5 s, $ s, 9 g, q g, 6 b, 8 b, @ a, ( c, c e, e c, o e, † t, f t, + t,
cl d, rn m, in m, ni m, nn m, m rn, m in, vv w, w vv, li h, h li, b h, h b, ii u, u ii, n u, u n, ri n, n ri, d ti, d cl, ti d, tl d, fi h, tt u, rri m, lc k, ji p, fl h, a o, o a, y v, v y, z 2, 2 z, ¢ c, € e, é e
"""
_pairs = {tuple(x.split()) for x in CONFUSIONS.replace("\n", " ").split(",")}
#: Cost of one confusion pair, of a swap of neighbours, of any other edit; accepted up to MOST.
PAIR_COST, SWAP_COST, EDIT_COST = 0.3, 0.7, 0.9
MOST = 0.95
#: Least length of a word in which edits other than confusion pairs are repaired.
LONG = 5
_by_wrong: dict[str, list[str]] = {}
for _w, _r in _pairs:
    _by_wrong.setdefault(_w, []).append(_r)
LONGEST_WRONG = max(map(len, _by_wrong))

#: Signs that divide a word at a line end.
HYPHENS = "-‐­¬"
_number = re.compile(r"^[\s\-–—\[\](|]*(?:page|p\.|pg\.?|seite|s\.)?\s*(?:\d{1,4}|[ivxl]{1,6})(?:\s*(?:of|/|von)\s*\d{1,4})?[\s\-–—\])|]*$", re.I)
_beside = re.compile(r"^\s*(?:(?P<a>\d{1,4}|[ivxl]{1,6})(?:\s{2,}|\s*[|·–—]\s+)(?P<b>\S.*)|(?P<c>\S.*?)(?:\s{2,}|\s+[|·–—]\s*)(?P<d>\d{1,4}|[ivxl]{1,6}))\s*$")
_edge = ".,;:?!'\"“”‘’)]}»«"


def _number_beside(line: str, stripped: str) -> re.Match | None:
    """The match of a line with a page number at its start or end; other lines are told by their outer characters."""
    a, b = stripped[:1], stripped[-1:]
    return _beside.match(line) if a.isdecimal() or b.isdecimal() or a in "ivxl" or b in "ivxl" else None


def _strip(w: str) -> str:
    return w.strip(_edge + "([{")


# --- lexicon --------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts per task: of words, and of word pairs as 'a b'."""
    raw: Counter = Counter()
    for b in batches:
        for x in b.iloc[:, 0]:
            if x:
                raw.update(x.split())
    words: Counter = Counter()
    for w, n in raw.items():
        s = _strip(w).lower()
        if s and not s[-1] in HYPHENS:
            words[s] += n
    yield pd.DataFrame({"w": list(words), "n": list(words.values())})


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n) of all words of a one-column table of texts."""
    return texts.mapInPandas(_count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def trusted_words(texts: DataFrame, share: float = SHARE, least: int = LEAST) -> dict[str, int]:
    """The frequent words. At most 1/share words can have that share, which bounds what is collected."""
    counts = cut_lineage(word_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(least, share * total)).limit(int(1 / share)).collect()
    return {r.w: r.n for r in rows}


def context_pairs(texts: DataFrame, words: dict[str, int], share: float = SHARE, least: int = LEAST) -> dict[tuple[str, str], int]:
    """Frequent pairs of trusted neighbours; their number is bounded as that of the words is."""
    listed = sorted(words)
    place = {w: i for i, w in enumerate(listed)}
    size = len(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def number(raw: str) -> int:
            if len(at) > 500_000:
                at.clear()
            n = at[raw] = place.get(_strip(raw).lower(), -1)
            return n

        for b in batches:
            ids = [at[w] if w in at else number(w) for x in b.iloc[:, 0] if x for w in (*x.split(), "")]
            a = np.array(ids, dtype=np.int64)
            both = (a[:-1] >= 0) & (a[1:] >= 0)
            k, n = np.unique(a[:-1][both] * size + a[1:][both], return_counts=True)
            keys, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        yield pd.DataFrame({"k": keys, "n": counts})

    total = sum(words.values())
    rows = texts.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, share * total)).limit(int(1 / share)).collect()
    return {(listed[r.k // size], listed[r.k % size]): r.n for r in rows}


# --- misread words ----------------------------------------------------------------------------


class Repairer:
    """Candidates over the trusted words by confusion pairs, weighted distance, context."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int] | None = None, most: float = MOST) -> None:
        """Without ``pairs`` no context is known, and edits of any kind are decided by distance and frequency."""
        self.words, self.pairs, self.most, self.blind = words, pairs or {}, most, pairs is None
        self.targets = {w for w in words if len(w) >= 3 and any(c.isalpha() for c in w)}
        self.prefixes: set[str] | None = None
        self.deleted: dict[str, list[str]] | None = None
        self.seen: dict[str, tuple[str, ...]] = {}
        self.near: dict[str, tuple[str, ...]] = {}
        self.judged: dict[str, bool | None] = {}
        self.right: set[str] = set()

    def _reached(self, w: str) -> dict[str, float]:
        """The targets that confusion pairs make of w, with their least cost, by a walk over the targets' prefixes."""
        if self.prefixes is None:
            self.prefixes = {t[:k] for t in self.targets for k in range(len(t) + 1)}
        prefixes = self.prefixes
        out: dict[str, float] = {}
        here: dict[int, dict[str, float]] = {0: {"": 0.0}}
        for i in range(len(w)):
            for p, c in here.pop(i, {}).items():
                if (t := p + w[i]) in prefixes:
                    at = here.setdefault(i + 1, {})
                    at[t] = min(at.get(t, c), c)
                if c + PAIR_COST > self.most:
                    continue
                for a in range(1, min(LONGEST_WRONG, len(w) - i) + 1):
                    for r in _by_wrong.get(w[i : i + a], ()):
                        if (t := p + r) in prefixes:
                            at = here.setdefault(i + a, {})
                            at[t] = min(at.get(t, c + PAIR_COST), c + PAIR_COST)
        for t, c in here.get(len(w), {}).items():
            if t in self.targets:
                out[t] = c
        return out

    def cost(self, w: str, right: str) -> float:
        """Weighted edit distance from the misreading w to the right word; 9 beyond ``most``."""
        n, m = len(w), len(right)
        big = 9.0
        d = [[big] * (m + 1) for _ in range(n + 1)]
        d[0][0] = 0.0
        for i in range(n + 1):
            for j in range(m + 1):
                v = d[i][j]
                if v > self.most:
                    continue
                if i < n and j < m:
                    d[i + 1][j + 1] = min(d[i + 1][j + 1], v if w[i] == right[j] else v + EDIT_COST)
                if i < n:
                    d[i + 1][j] = min(d[i + 1][j], v + EDIT_COST)
                if j < m:
                    d[i][j + 1] = min(d[i][j + 1], v + EDIT_COST)
                if w[i : i + 2] == right[j : j + 2][::-1] and i + 1 < n and j + 1 < m:
                    d[i + 2][j + 2] = min(d[i + 2][j + 2], v + SWAP_COST)
                for a in range(1, min(LONGEST_WRONG, n - i) + 1):
                    for r in _by_wrong.get(w[i : i + a], ()):
                        if right.startswith(r, j):
                            d[i + a][j + len(r)] = min(d[i + a][j + len(r)], v + PAIR_COST)
        return d[n][m] if d[n][m] <= self.most + 1e-9 else big

    def edited(self, w: str) -> tuple[str, ...]:
        """Trusted words at one edit of an unknown word, best first, by the deletion index; word endings are no edits."""
        hit = self.near.get(w)
        if hit is not None:
            return hit
        if self.deleted is None:
            self.deleted = {}
            for t in self.targets:
                if len(t) >= LONG:
                    for k in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}:
                        self.deleted.setdefault(k, []).append(t)
        out: tuple[str, ...] = ()
        if len(w) >= LONG and w.isalpha() and w not in self.words:
            found = {t for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for t in self.deleted.get(k, ()) if abs(len(t) - len(w)) < 2}
            costs = {t: c for t in found if not self._ending(w, t) and (c := self.cost(w, t)) <= self.most}
            out = tuple(sorted(costs, key=lambda t: (costs[t], -self.words[t])))
        if len(self.near) > 500_000:
            self.near.clear()
        self.near[w] = out
        return out

    @staticmethod
    def _ending(w: str, t: str) -> bool:
        """Do the words differ in their last letters alone (number, tense), other than by a letter read twice?"""
        k = min(len(w), len(t)) - 1
        return w[:k] == t[:k] and not (len(w) == len(t) + 1 and w[:-1] == t and w[-1] == w[-2])

    def candidates(self, w: str) -> tuple[str, ...]:
        """Accepted repairs of a word, best first; () for a word that is right or unknown."""
        hit = self.seen.get(w)
        if hit is not None:
            return hit
        found: dict[str, float] = {}
        n = self.words.get(w, 0)
        if len(w) >= 3 and sum(c.isalpha() for c in w) >= 2:
            found = {t: c for t, c in self._reached(w).items() if t != w and self.words[t] >= RATIO * max(n, 1)}
        out = tuple(sorted(found, key=lambda t: (found[t], -self.words[t])))
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[w] = out
        return out

    def repair(self, raw: str, before: str = "", after: str = "") -> str | None:
        """The repaired token, or None if it needs none."""
        core = raw.strip(_edge)
        low = core.lower().lstrip("[{\"“«'‘")
        if not low:
            return None
        inner = low.lstrip("(")
        if inner in self.words and not self.candidates(inner):
            return None
        parts = inner.split("-")
        if len(parts) > 1 and all(p in self.words for p in parts if p):
            return None
        options = self.candidates(inner)
        start = inner
        if not options and low.startswith("("):
            start, options = low, self.candidates(low)
        if not options and raw.rstrip(".,;:").endswith(("!", ")")) and (t := raw.rstrip(".,;:").lower()) != core.lower():
            start, options = t, self.candidates(t)
        beside = lambda t: self.pairs.get((before, t), 0) + self.pairs.get((t, after), 0)
        if not options:
            if len(parts) > 1:
                fixed = [p if p in self.words else (self.candidates(p) or (None,))[0] for p in parts]
                return raw.replace(core, "-".join(fixed)) if all(fixed) else None
            options = tuple(t for t in self.edited(inner) if self.blind or beside(t))
            start = inner
            if not options:
                return None
        best = max(options, key=lambda t: (beside(t), -self.cost(start, t)))
        if core[:1].isupper():
            best = best[0].upper() + best[1:]
        at = raw.lower().find(start)
        return raw[:at] + best + raw[at + len(start) :]

    def misread(self, raw: str) -> bool | None:
        """Whether repair() changes the token; None if that depends on its neighbours."""
        hit = self.judged.get(raw, "new")
        if hit == "new":
            if len(self.judged) > 500_000:
                self.judged.clear()
                self.right.clear()
            hit = self.repair(raw) is not None
            if not hit and not self.blind and self.edited(raw.strip(_edge).lower().lstrip("[{\"“«'‘(")):
                hit = None
            self.judged[raw] = hit
            if hit is False:
                self.right.add(raw)
        return hit


_repairers: dict[str, Repairer] = {}


def repairer(token: str, words: dict[str, int], pairs: dict[tuple[str, str], int]) -> Repairer:
    """One repairer per worker and query, so that its indexes and caches serve all tasks."""
    if token not in _repairers:
        _repairers.clear()
        _repairers[token] = Repairer(words, pairs)
    return _repairers[token]


# --- lines ------------------------------------------------------------------------------------


def _is_furniture(s: str, own: str, nxt: str, width: int, lower: bool = False) -> bool:
    """Could this line be a header? It is no sentence end, no table row, and the next word had room."""
    if not s or len(s) > 110 or s.startswith("|") or not any(c.isalpha() for c in s):
        return False
    if (s[0].islower() and not lower) or s[0] == "(" or (own[0].isdigit() and not re.match(r"^\d+(?:\.\d+)?(?:\s+[^\W\d_a-z]|\s\s+[^\W\d_])", own)):
        return False
    if s[-1] in ".;:,?" + HYPHENS and not re.search(r"(?:et al\s*\.|\.\.\.|…|\s[.;,])$", s) and not (lower and s[-1] == ":"):
        return False
    if lower and re.match(r"^(?:\w{1,8}\s+)?[^\W\d_]+\s+/\s", own):  # author / title
        return True
    first = nxt.split(" ", 1)[0] if nxt else ""
    return len(own) + 1 + len(first) < width


def clean_lines(text: str, edges: bool) -> tuple[list[str], set[str]]:
    """Body lines ('' between paragraphs) and the kinds of lines removed.

    ``edges``: the text is one page, headers stand at its first and last lines; otherwise page
    breaks lie inside the text.
    """
    lines = [x.rstrip() for x in re.split(r"\r\n?|\n|\f", text)]
    stripped = [x.strip() for x in lines]
    full = [i for i, x in enumerate(stripped) if x]
    noise: set[str] = set()
    if not full:
        return [], noise
    number = {i for i in full if len(stripped[i]) < 16 and _number.match(stripped[i])}
    wrapped = sorted((len(stripped[i]) for i in full), reverse=True)
    width = wrapped[min(2, len(wrapped) - 1)] if len(wrapped) > 3 else wrapped[0]
    drop: set[int] = set()
    place = {i: k for k, i in enumerate(full)}

    def after_numbers(i: int) -> str:
        """The line that goes on after a page break: beyond page numbers and what may be a header."""
        ahead = [stripped[j] for j in full[place[i] + 1 : place[i] + 4] if j not in number]
        return next((x for x in ahead[:2] if not edges and not x[0].isupper()), ahead[0] if ahead else "")

    def near(i: int, step: int) -> int | None:
        k = place[i] + step
        return full[k] if 0 <= k < len(full) else None

    if edges:
        for order in (full, full[::-1]):
            left = 2  # a header and a page number at either edge
            for i in order[:2]:
                if i in number:
                    drop.add(i)
                    noise.add("page_number")
                    left -= 1
                    continue
                s = stripped[i]
                m = _number_beside(lines[i], s)
                body = (m["b"] or m["c"]) if m else s
                after = near(i, 1)
                nxt = stripped[after] if after is not None else ""
                prev = near(i, -1)
                if order is full:
                    nxt = after_numbers(i)
                    begins = not nxt or nxt[:1].isupper() or not nxt[:1].isalpha()
                    room = width if len(full) > 2 else 200
                    ok = begins and _is_furniture(body, s, nxt, room, True)
                else:
                    ends = prev is None or prev in number or prev in drop or stripped[prev][-1] in ".?!)" or "|" in stripped[prev] or not any(c.isalpha() for c in stripped[prev])
                    ok = ends and _is_furniture(body, s, "", max(width, 60), True)
                if not ok or left == 0:
                    break
                drop.add(i)
                noise.add("header")
                if m:
                    noise.add("page_number")
                left -= 1
    else:
        for i in full:
            if i in number:
                drop.add(i)
                noise.add("page_number")
        for i in full:
            if i in number:
                continue
            s = stripped[i]
            m = _number_beside(lines[i], s)
            body = (m["b"] or m["c"]) if m else s
            a, b = near(i, -1), near(i, 1)
            prev, nxt = (stripped[a] if a is not None else ""), (stripped[b] if b is not None else "")
            beside = (a in number and i - a <= 2) or (b in number and b - i <= 2)
            inside = a is not None and b is not None
            goes_on = bool(nxt) and (nxt[0].islower() or prev[-1:] not in ".?!:")
            if beside or (inside and i - a == 1 and b - i == 1 and goes_on) or m:
                lower = bool(beside or m) and len(s) + 12 < width
                if _is_furniture(body, s, after_numbers(i), width, lower):
                    drop.add(i)
                    noise.add("header")
                    if m:
                        noise.add("page_number")
    out: list[str] = []
    for i, s in enumerate(lines):
        if i in drop:
            continue
        out.append(s.strip())
    return out, noise


def join_lines(lines: list[str], words: dict[str, int]) -> tuple[str, bool]:
    """Continuous paragraphs; whether a word was divided at a line end."""
    paragraphs: list[list[str]] = [[]]
    divided = False
    for line in lines:
        if not line:
            if paragraphs[-1]:
                paragraphs.append([])
            continue
        cur = paragraphs[-1]
        last = cur[-1].rstrip(" \t") if cur else ""
        if last and last[-1] in HYPHENS and len(last) > 1 and last[-2].isalnum():
            front, _, head = last[:-1].rpartition(" ")
            tail, _, rest = line.partition(" ")
            t = tail.strip(_edge)
            if t[:1].isalpha() or t[:1] in "@†(!015":
                a, b = head.lower().lstrip("("), t.lower()
                whole = words.get(a + b, 0)
                compound = words.get(f"{a}-{b}", 0)
                parts = words.get(a, 0) and words.get(b, 0)
                keep = compound > whole or (not whole and not compound and bool(parts) and b[:1].islower() and last[-1] == "-")
                mark = "-" if keep else ""
                if not keep and b[:1].islower() | (not b[:1].isalpha()):
                    divided = True
                cur[-1] = (front + " " if front else "") + head + mark + tail
                if rest:
                    cur[-1] += " " + rest
                continue
        cur.append(line)
    return "\n\n".join(" ".join(p) for p in paragraphs if p), divided


def examine(text: str | None, edges: bool, fix: Repairer, rewrite: bool = False) -> tuple[set[str], str | None]:
    """The kinds of noise in a text and, if ``rewrite``, the repaired text."""
    if not text:
        return set(), text
    lines, noise = clean_lines(text, edges)
    body, divided = join_lines(lines, fix.words)
    if divided:
        noise.add("hyphen")
    if not rewrite:
        kinds = {w: fix.misread(w) for w in set(body.split()) - fix.right}
        open_ = {w for w, m in kinds.items() if m is None}
        if any(kinds.values()):
            noise.add("ocr")
        elif open_:
            for p in body.split("\n\n"):
                ws = p.split(" ")
                low = lambda k: _strip(ws[k]).lower() if 0 <= k < len(ws) else ""  # noqa: B023, E731
                if any(w in open_ and fix.repair(w, low(k - 1), low(k + 1)) is not None for k, w in enumerate(ws)):
                    noise.add("ocr")
                    break
        return noise, None
    out = []
    for p in body.split("\n\n"):
        ws = p.split(" ")
        low = [_strip(w).lower() for w in ws]
        for k, w in enumerate(ws):
            r = fix.repair(w, low[k - 1] if k else "", low[k + 1] if k + 1 < len(ws) else "")
            if r is not None:
                noise.add("ocr")
                ws[k] = r
        out.append(" ".join(ws))
    return noise, "\n\n".join(out)


# --- tables ---------------------------------------------------------------------------------------


def items(pages: DataFrame, sections: DataFrame) -> DataFrame:
    a = pages.select(F.lit("extracted_pages").alias("item_table"), F.col("page_id").alias("item_id"), "text")
    return a.unionByName(sections.select(F.lit("sections_flat").alias("item_table"), F.col("section_id").alias("item_id"), "text"))


def noise_found(texts: DataFrame) -> DataFrame:
    """(item_table, item_id, noise): each text and each kind of noise in it."""
    words = trusted_words(texts.select("text"))
    pairs, token = context_pairs(texts.select("text"), words), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(token, words, pairs)
        for b in batches:
            rows = [(t, i, k) for t, i, x in zip(b.item_table, b.item_id, b.text, strict=True) for k in sorted(examine(x, t == "extracted_pages", fix)[0])]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "noise"])

    return spread(texts.where(F.length("text") > 0), "item_id").mapInPandas(run, "item_table string, item_id long, noise string")


def repaired(texts: DataFrame) -> DataFrame:
    """(item_table, item_id, noise array, text): every text as continuous readable paragraphs."""
    words = trusted_words(texts.select("text"))
    pairs, token = context_pairs(texts.select("text"), words), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(token, words, pairs)
        for b in batches:
            got = [examine(x, t == "extracted_pages", fix, True) for t, x in zip(b.item_table, b.text, strict=True)]
            yield pd.DataFrame({"item_table": b.item_table, "item_id": b.item_id, "noise": [sorted(g[0]) for g in got], "text": [g[1] for g in got]})

    return spread(texts, "item_id").mapInPandas(run, "item_table string, item_id long, noise array<string>, text string")
