"""The nine operators against brute force, round trips and odd input."""

import json
import random
import re
import string
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import containers as ct
from paperloom.llm import cross_match as cm
from paperloom.llm import format_duplicates as fd
from paperloom.llm import lookalikes as la
from paperloom.llm import mixture as mx
from paperloom.llm import page_noise as pg
from paperloom.llm import paper_names as names
from paperloom.llm import pieces as pc
from paperloom.llm import retrieval as rt
from paperloom.llm import term_mapping as tm
from paperloom.llm import tokens as tk
from paperloom.llm import truncation as tr

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
needs_vocabulary = pytest.mark.skipif(not Path(tk.VOCABULARY).exists(), reason="no vocabulary")


# --- 1 ---


def key(s):
    return re.sub(r"[\W_]+", "", (s or "").upper())


def test_format_duplicates_against_brute_force(spark):
    r = random.Random(1)
    base = [("Alpha beta", "10.1234/x"), ("Alpha beta", None), ("alphabeta", "doi: 10.1234/X"), ("ALPHA-beta!", "https://doi.example/10.1234/x"), ("Gamma", ""), ("gamma", None), ("—", None), (None, None), ("beta alpha", "10.1234/x"), ("Ünï 1", "10.9/a b")]
    rows = [(i, *r.choice(base)) for i in range(120)]
    s = spark.createDataFrame(rows, "id long, title string, doi string").withColumn("extra", F.lit(1))
    groups = defaultdict(list)
    for i, t, d in rows:
        dk = key(fd._label_re.sub("", fd._lead_re.sub("", (d or "").lower())))
        if key(t) or dk:
            groups[key(t), dk].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i > min(g)}
    got = fd.copies_found(fd.format_duplicates(fd.staged_sources(s)))
    assert {(x.first_id, x.copy_id) for x in got.collect()} == want
    kept = fd.collapsed(fd.format_duplicates(fd.staged_sources(s))).collect()
    assert sum(x.copies for x in kept) == sum(len(g) for g in groups.values() if len(g) > 1)


def test_format_duplicates_records_and_terms(spark):
    a = {"title": "T x", "DOI": "10.1/A", "n": 5, "l": ["p", {"q": 1}]}
    raws = [json.dumps(a), json.dumps({"n": "5", "l": ["P.", {"q": "1"}], "DOI": "https://doi.example/10.1/a", "title": "{T} X"}), json.dumps(a | {"l": [{"q": 1}, "p"]}), json.dumps(a | {"z": None}), "{bad", "{bad", None, None, "[1]", "[2]"]
    items = spark.createDataFrame(list(enumerate(raws)), "raw_id long, raw string")
    got = fd.copies_found(fd.format_duplicates(fd.staged_records(items)))
    assert {(x.first_id, x.copy_id) for x in got.collect()} == {(0, 1), (4, 5)}
    terms = spark.createDataFrame([(1, 1, "A b"), (2, 1, "a-B"), (3, 2, "ab"), (4, None, "ab"), (5, None, "ab"), (6, 1, "--"), (7, 1, "!!"), (8, 1, None)], "id long, document_id long, label string")
    assert {(x.first_id, x.copy_id) for x in fd.copies_found(fd.format_duplicates(fd.staged_terms(terms))).collect()} == {(1, 2)}
    assert fd.format_duplicates(fd.staged_terms(terms.limit(0))).count() == 0


# --- 2 ---


def test_pieces_round_trip():
    r = random.Random(5)
    texts = ["", "a", "x" * 1000, "# H\n\npara one.\n\n" * 40, "word " * 400, "\n".join("1. item " + "z" * r.randint(1, 90) for _ in range(60))]
    texts += ["".join(r.choice(string.ascii_letters + "  .\n#") for _ in range(r.randint(1, 3000))) for _ in range(60)]
    for t in texts:
        spans = pc.cut(t, 200, 20)
        assert "".join(t[b:e] for _, b, e, _ in spans) == t
        assert all(e - a <= 200 for a, _, e, _ in spans) and all(a <= b for a, b, _, _ in spans)


def test_pieces_boundaries(spark):
    text = "## One\n\n" + "Aa bb cc. " * 12 + "\n\n## Two\n\n" + "Dd ee ff. " * 12
    spans = pc.cut(text, 150, 10)
    assert "heading" in {w for *_, w in spans} and "character" not in {w for *_, w in spans}
    d = spark.createDataFrame([("t", 1, text), ("t", 2, "short"), ("t", 3, None), ("t", 4, ""), ("u", 5, text)], "item_table string, item_id long, text string")
    limits = spark.createDataFrame([("t", 150, 10)], "item_table string, max_size int, overlap int")
    p = pc.split_oversized(d, limits)
    assert {(x.item_table, x.item_id) for x in pc.oversized_found(p).collect()} == {("t", 1)}
    assert {x.item_id for x in p.collect()} == {1, 2, 5}


# --- 3 ---


def test_names():
    p = names.parse_file("Öst et al. - 2001 - A study of x in wat.pdf", None)
    assert p.years == {"2001"} and p.authors == {"ost"} and p.titles == [("a study of x in wat".split(), True, False)]
    p = names.parse_file("doi-10-1234-ab-5-0123abcd_v2.pdf", "## References\n\ndoi:10.9999/other")
    assert p.dois == {"101234ab5"}
    p = names.parse_file("scan12.pdf", '---\ntitle: "T, Part II"\nyear: 1999\ndoi: "10.1/z"\n---\nbody')
    assert p.titles[0][0] == ["t", "#2"] and p.years == {"1999"}
    assert not names.parse_file(None, None).titles
    assert names.align("a modle of growth".split(), "a model of growth in water".split(), False, False) == (1.0, 2)


def test_cross_match(spark):
    r = random.Random(8)
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(5)) for _ in range(80)]
    src = [(i, f"Growth of {w} in water and other media", f"10.1234/{i}" if i % 3 else None, str(1990 + i % 9), [("Smith" + w, "A", "author")]) for i, w in enumerate(words)]
    src += [(1000, src[4][1].upper(), "doi:10.1234/4", None, None), (1001, None, None, None, None)]
    s = spark.createDataFrame(src, "id long, title string, doi string, year string, creators array<struct<family:string,given:string,type:string>>")
    files = [(1, f"Smith{words[3]} - {1990 + 3} - Growth of {words[3]} in water and oth.pdf", None, None), (2, "scan1.pdf", "doi: 10.1234/4\nA Author\n\nBody text here.", None), (3, "scan2.pdf", "Body only. Nothing else.", None), (4, None, None, None), (5, "x.md", f"# Growth of {words[7]} in watxer and other media\n\nBody.", None)]
    d = spark.createDataFrame(files, "id long, filename string, content string, source_id long")
    got = {(r.source_id, r.document_id) for r in cm.match(s, d).collect()}
    assert got == {(3, 1), (4, 2), (1000, 2), (7, 5)}
    assert cm.match(s.limit(0), d).count() == 0


def common_titles(spark, more=()):
    """30 records of one title, all of whose title terms have long lists, among 1,000 others."""
    r = random.Random(9)
    other = [(1000 + i, " ".join("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(4)), None, None, None) for i in range(1000)]
    rows = [(i, "Growth of crystals in water", None, str(1980 + i), None) for i in range(30)] + other + list(more)
    return spark.createDataFrame(rows, "id long, title string, doi string, year string, creators array<struct<family:string,given:string,type:string>>")


FILES = "id long, filename string, content string, source_id long"


def test_cross_match_term_of_no_record(spark):
    d = spark.createDataFrame([(1, "Growth of crystals in watxer.pdf", None, None)], FILES)
    assert {(r.source_id, r.document_id) for r in cm.match(common_titles(spark), d).collect()} == {(i, 1) for i in range(30)}


def test_cross_match_rare_term_of_another_record(spark):
    s = common_titles(spark, [(5000, "Waiter problems solved", None, None, None)])
    d = spark.createDataFrame([(1, "Growth of crystals in waiter.pdf", None, None)], FILES)
    assert {(r.source_id, r.document_id) for r in cm.match(s, d).collect()} == {(i, 1) for i in range(30)}


def test_cross_match_equal_doi_of_another_year(spark):
    s = common_titles(spark, [(5000, "Things of glass and stone", "10.1234/z", "1999", None)])
    d = spark.createDataFrame([(1, "x.md", '---\ntitle: "Things of glass and stone"\nyear: 2000\ndoi: "10.1234/z"\n---\nBody.', None)], FILES)
    assert {(r.source_id, r.document_id) for r in cm.match(s, d).collect()} == {(5000, 1)}


def test_cross_match_of_several_works(spark):
    t = "Things of glass and stone"
    s = common_titles(spark, [(5000, t, "10.1234/a", "2001", [("Smith", "A", "author")]), *((5001 + i, t, f"10.1234/b{i}", None, None) for i in range(3))])
    d = spark.createDataFrame([(1, f"Smith - 2001 - {t}.pdf", None, None), (2, f"{t}.pdf", None, None)], FILES)
    got = {(r.source_id, r.document_id): r.confidence for r in cm.match(s, d).collect()}
    assert set(got) == {(5000, 1), *((5000 + i, 2) for i in range(4))}
    assert all(v < 0.3 for (_, i), v in got.items() if i == 2) and got[5000, 1] > 0.5


# --- 4 ---


def test_term_mapping(spark):
    t = spark.createDataFrame([("T1", "Protein solubility", ["protein saturation content", None, ""]), ("T2", "seed viscosity", None), ("T3", "high-salt class hierarchy", ["HSCH"])], "term_id string, label string, synonyms array<string>")
    cases = {
        "protein  SOLUBILITY": "T1", "solubility, protein": "T1", "protien solubilitty": "T1", "ProteinSolubility": "T1", "proteinsolubility": "T1", "protein solubilities": "T1", "the protein solubility (measured)": "T1", "protein sol.": "T1",
        "seed solubility": None, "protein": None, "h.s.c.h.": "T3", "High_salt/class hierarchy n.o.s.": "T3", "strain X-12": None, "": None, "—": None, None: None,
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([*cases, "protein  SOLUBILITY"])], "id long, label string").withColumn("term_id", F.lit("clash"))
    got = {r.id: r.term_id for r in tm.mapped_rows(rows, t).collect()}
    assert got == {i: v for i, v in enumerate([*cases.values(), "T1"]) if v}
    assert tm.map_rows(rows, t).count() == rows.count()
    assert tm.mapped_rows(rows, t.limit(0)).count() == 0


def test_term_mapping_joined_tokens(spark):
    t = spark.createDataFrame([("T1", "alpha-helix residence time distribution", None), ("T2", "x-ray beta-sheet content of dry-milled seeds", None), ("T3", "pH-stat", None)], "term_id string, label string, synonyms array<string>")
    cases = {"alphahelix residence time distribution": "T1", "alphahelix resydense tyme distribution": "T1", "xray betasheet content of drymilled seeds": "T2", "al pha helix residence time distri bution": "T1", "phstat": "T3", "alphahelix time distribution": None}
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, label string")
    assert {r.id: r.term_id for r in tm.mapped_rows(rows, t).collect()} == {i: v for i, v in enumerate(cases.values()) if v}


def test_distance_bound():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(3, 7))) for _ in range(2))
        if tm.distance(a, b, 2) <= 2:
            assert tm.deletions(a, 2) & tm.deletions(b, 2)


# --- 5 ---


def test_truncation(spark):
    full = "Linking flocculation data of catalase to a mechanistic model: consequences for impurity removal and downstream filtration"
    cols = "meta_id long, intake string, title string, citation string, year string, pdf_filename string, pdf_path string, lead_author string"
    rows = [
        (1, "a", full[:70], f"Doe (2001). {full}. Journal, 3.", "2001", "doe2001catalase.pdf", None, "Doe"),
        (2, "a", full, f"Doe (2001). {full}. Journal, 3.", "2001", f"Doe - 2001 - {full.replace(':', '')[:50]}.pdf", None, "Doe"),
        (3, "a", full[:60] + "...", None, None, "x.pd", None, None), (4, "a", full, None, "2001", None, None, "Doe"), (5, "a", None, None, None, "", None, None), (6, None, full[:90], None, "2001", f"Doe - 2001 - {full.replace(':', '')}.pdf", None, "Doe"),
    ]
    d = spark.createDataFrame(rows, cols)
    got = {(r.meta_id, r.field) for r in tr.truncated(d).collect()}
    assert got == {(1, "title"), (2, "pdf_filename"), (3, "title"), (3, "pdf_filename"), (6, "title")}
    rates = {(r.intake, r.field): (r["values"], r.truncated) for r in tr.rates(d, tr.truncated(d)).collect()}
    assert rates["a", "title"] == (4, 2) and rates[None, "title"] == (1, 1)
    assert tr.truncated(d.limit(0)).count() == 0


def test_truncation_copies_of_other_length_and_author(spark):
    cols = "meta_id long, intake string, title string, citation string, year string, pdf_filename string, pdf_path string, lead_author string"
    titles = [
        (1, "Towards an ontology of fish", "2001", "Doe"), (2, "Towards an ontology of fish and salt", "2001", "Doe"), (3, "Towards an ontology of form and many longer words", "2001", "Doe"),
        (4, "On the turbidit", "1999", "Ray"), (5, "On the turbidity of wine", "1999", "Ray"), (6, "Glass beads under", "1998", "Roe J"), (7, "Glass beads under load", "1998", "Roe"),
        (8, "Heat in sol", "1990", "Fay"), (9, "Heat in solids", "1991", "Kim"), (10, "Milk of cows", "1980", "Lee"), (11, "Milk of cows in May", "1985", "Ash"),
    ]
    d = spark.createDataFrame([(i, "a", t, None, y, None, None, w) for i, t, y, w in titles], cols)
    assert {r.meta_id for r in tr.truncated(d).collect()} == {1, 4, 6, 8}
    values = d.select(F.lower("title").alias("v"), F.lit("x").alias("who"))
    want = {(a, b) for a in (t[1].lower() for t in titles) for b in (t[1].lower() for t in titles) if b != a and b.startswith(a)}
    assert {r.v for r in tr.longer_copies(values).where("same").collect()} == {a for a, _ in want}


def test_truncation_copies_across_ranges(spark):
    r = random.Random(4)
    vs = sorted({"".join(r.choice("ab ") for _ in range(r.randint(1, 9))) for _ in range(400)} | {"a" * k for k in range(1, 30)})
    d = spark.createDataFrame([(v, w) for v in vs for w in ("doe 2001", "kim 1999")], "v string, who string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.v, x.inside) for x in tr.longer_copies(d).where("same").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(v, any(w.startswith(v) and w[len(v)] != " " for w in vs if w != v)) for v in vs if any(w != v and w.startswith(v) for w in vs)}


# --- 6 ---


def test_page_noise(spark):
    clean = ["the mechanistic model describes crystal growth and", "reproduces the solubility within ten percent of error.", "a salt-free solution was used for the measurement of", "the membrane transport in the stirred tank reactor now."]
    noisy = "Journal of Things 3 (2001)\n" + "The mechanistic model de5cribes crystal growth and the mem-\nbrane transport in the stirred tank reactor, a salt-\nfree solution that was used for the measurement of model.\n- 7 -"
    rows = [("extracted_pages", i, "\n".join(clean)) for i in range(40)] + [("extracted_pages", 100, noisy), ("extracted_pages", 101, None), ("extracted_pages", 102, ""), ("extracted_pages", 103, "Q" * 5000)]
    t = spark.createDataFrame(rows, "item_table string, item_id long, text string")
    found = {(r.item_id, r.noise) for r in pg.noise_found(t).collect()}
    assert found == {(100, k) for k in ("header", "page_number", "hyphen", "ocr")}
    text = {r.item_id: r.text for r in pg.repaired(t).collect()}
    assert text[100] == "The mechanistic model describes crystal growth and the membrane transport in the stirred tank reactor, a salt-free solution that was used for the measurement of model."
    assert text[101] is None and text[102] == ""


def test_page_noise_misread_word_of_the_lexicon():
    fix = pg.Repairer({"between": 10000, "be†ween": 27, "phases": 500, "the": 90000})
    text = "the gap be†ween the phases"
    assert pg.examine(text, False, fix)[0] == pg.examine(text, False, fix, True)[0] == {"ocr"}
    assert pg.examine("the gap between the phases", False, fix)[0] == set()


def test_page_noise_every_confusion_pair():
    for wrong, right in pg._pairs:
        fix = pg.Repairer({f"star{right}ne": 1000})
        assert fix.candidates(f"star{wrong}ne") == (f"star{right}ne",), (wrong, right)
    fix = pg.Repairer({"crystallization": 1000, "the": 9000, "have": 800})
    assert fix.repair("cry5tallizat1on,") == "crystallization,"
    assert fix.repair("Tbe") == "The" and fix.repair("bave") == "have" and fix.repair("save") is None


# --- 7 ---


def test_packing():
    r = random.Random(3)
    for n in (0, 1, 5, 300):
        sizes = [r.randint(0, 100) for _ in range(n)]
        where = ct.pack(sizes, 100)
        load = defaultdict(int)
        for w, s in zip(where, sizes, strict=True):
            load[w] += s
        assert all(v <= 100 for v in load.values())
        if n == 300:
            assert sum(sizes) / (100 * len(load)) > 0.9


@needs_vocabulary
def test_counts_equal_the_tokenizer():
    t = tk.tokenizer()
    r = random.Random(4)
    for _ in range(300):
        s = "".join(r.choice(["a", "Word", " ", "  ", "\n", "é", "1", "!", " ", "it's", "я"]) for _ in range(r.randint(0, 40)))
        assert t.count(s) == t._one(s)
        parts = t.divide(s, 5)
        assert "".join(s[a:b] for a, b, _ in parts) == s or not parts
        assert all(n <= 5 or b - a == 1 for a, b, n in parts)


@needs_vocabulary
def test_containers(spark):
    d = spark.createDataFrame([(i, "word " * (i * 7 % 400)) for i in range(200)] + [(900, "long text " * 3000), (901, None), (902, "")], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    p = ct.fill_containers(d, 512)
    rows = p.collect()
    load = defaultdict(int)
    for r in rows:
        load[r.container_id] += r.tokens
    assert max(load.values()) <= 512
    assert {r.doc_id for r in rows} == {*range(200), 900, 902}
    assert sum(1 for r in rows if r.doc_id == 900) > 1 and all(sum(1 for r in rows if r.doc_id == k) == 1 for k in range(200))


# --- 8 ---


def test_flow_prefers_few_repetitions():
    flow = mx.min_cost_flow([100, 50], [120, 60], [[0], [0, 1]], [1, 3])
    assert sum(f.get(0, 0) for f in flow) == 120 and sum(f.get(1, 0) for f in flow) == 60


@needs_vocabulary
def test_mixture(spark):
    rows = [(i, "text number %d about things" % i, "big") for i in range(900)] + [(1000 + i, "small text %d here" % i, "small") for i in range(40)] + [(2000 + i, "text number %d about things" % i, "small") for i in range(30)] + [(3000, "x", None), (3001, None, "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mx.mix(d, w)
    share = {r.source: r.actual_share for r in mx.share_report(m, w).collect()}
    assert abs(share["big"] / share["small"] - 3.5) < 0.35 and share["absent"] == 0
    assert m.where("source = 'small'").agg(F.max("uses")).first()[0] <= 2 and m.where("source = 'big'").agg(F.max("uses")).first()[0] == 1
    assert mx.mix(d.limit(0), w).count() == 0


@needs_vocabulary
def test_mixture_with_an_absent_source_uses_all_that_the_others_have(spark):
    assert mx._best_size([10], [0.5, 0.5], [[0]], [1, 1]) == 20 and mx._best_size([1], [0.5, 0.5], [[0]], [1, 1]) == 2
    d = spark.createDataFrame([(i, "text number %d about things" % i, "big") for i in range(40)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("big", 0.5, 1), ("absent", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mx.mix(d, w).select("doc_id", "uses").distinct().count() == 40


def test_targets_agree_with_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    assert next(k for k in entry.queries() if k.startswith("p8_")) == "p8_mixture"
    long = " ".join("word%d" % i for i in range(400))
    docs = [(1, long, "A"), (2, "short text", "B"), (3, "other text", "zero"), (4, "third text", "none"), (5, "", "empty"), (6, None, "null"), (7, " ", "blank"), (8, "no source", None)]
    names = ["A", "B", "empty", "null", "blank", "absent", "B", None]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    weights = [(x, 0.125, 1) for x in names] + [("zero", 0.0, 1), ("none", None, 1)]
    spark.createDataFrame(weights, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_weights.parquet")
    con = duckdb.connect()
    for t in ("documents", "source_weights"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()["p8_targets"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(entry.oracle_sql()["p8_targets"]).fetchall()))


# --- 9 ---


def test_lookalikes(spark):
    same = ["Café fish at 5 °C", "Café ﬁsh at 5 ℃", "Саfé f​ish at ５ °Ϲ"]
    other = ["Cafe fish at 5 °C", "CAFÉ fish at 5 °C", "x²", "x2", "½", "1/2"]
    texts = [*same, same[0], *other, None, "", "​"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit(1))
    got = {(r.doc_id_a, r.doc_id_b) for r in la.alike_pairs(d).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (11, 12)}
    forms = {r.doc_id: r.form for r in la.consistent_form(d).collect()}
    assert len({forms[i] for i in range(4)}) == 1 and forms[10] is None
    assert la.alike_pairs(d.limit(0)).count() == 0


# --- all ---


@needs_data
def test_queries_agree_with_sql(spark):
    import duckdb

    from paperloom.llm import queries as q

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, DATA)
        r = con.sql(sql)
        at = [r.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(x[i] for i in at) for x in r.fetchall())


# --- 3: retrieval ---


def brute(records, query, ratio):
    """All records within ratio of the best BM25 score, by definition."""
    n, mean = len(records), sum(sum(r.values()) for r in records) / len(records)
    df = defaultdict(int)
    for r in records:
        for t in r:
            df[t] += 1
    score = {}
    for k, r in enumerate(records):
        length = sum(r.values())
        x = sum(rt.idf(float(df[t]), n) * rt.impact(r[t], length, mean) for t in query if t in r)
        if x > 0:
            score[k] = float(x)
    best = max(score.values(), default=0.0)
    return {k for k, v in score.items() if v >= ratio * best - 1e-9}, best


@pytest.mark.parametrize("few", [0, 500])
def test_pruned_search_equals_brute_force(few, monkeypatch):
    monkeypatch.setattr(rt, "FEW", few)
    r = random.Random(11)
    pool = [int(2**40 * r.random()) for _ in range(60)]
    records = [{t: r.randint(1, 3) for t in r.choices(pool, weights=[1 / (i + 1) for i in range(60)], k=r.randint(1, 12))} for _ in range(400)]
    keys = [sorted(x) for x in records]
    n, mean = len(records), sum(sum(x.values()) for x in records) / len(records)
    df = defaultdict(int)
    for x in records:
        for t in x:
            df[t] += 1
    parts = []
    for half in (range(0, 250), range(250, 400)):
        terms, starts, recs, tf, lengths = rt.Shard.build([np.array(keys[k]) for k in half], [np.array([records[k][t] for t in keys[k]]) for k in half])
        weights = rt.idf(np.array([df[int(t)] for t in terms], float), n)
        parts.append((rt.Shard(terms, starts, recs, rt.impact(tf, lengths[recs], mean), weights, len(half)), [list(half)]))

    class Two:
        shards = 2

        def shard(self, k):
            return parts[k]

    queries = [sorted(set(r.sample(pool, r.randint(1, 10)) + [5])) for _ in range(150)]
    for ratio in (0.4, 0.7, 1.0):
        found = [[] for _ in queries]
        best, _ = rt.search_all(Two(), [np.array(q) for q in queries], ratio, lambda q, c, rec, sc, f=found: f[q].extend((c[0][k], x) for k, x in zip(rec, sc, strict=True)))
        for q, query in enumerate(queries):
            want, top = brute(records, query, ratio)
            assert abs(best[q] - top) < 1e-9
            assert {k for k, x in found[q] if x >= ratio * best[q] - 1e-9} == want


def test_rivals_are_kept_without_a_list_of_all_candidates():
    r = random.Random(5)
    for _ in range(3000):
        known = r.random() < 0.3
        cands = [(k, r.choice(["", "", "a", "b", "c"]), r.choice([0.0, 0.0, 0.0, 0.3, 0.7, 0.9, 0.95]), r.random()) for k in range(r.randint(1, 30))]
        best = max(c[3] for c in cands)
        some = cm.Found(0.0 if known else cm.LEAST)
        for c in cands:
            some.add(c)
        assert len(some.rest) <= 2
        rows = []
        for mine in (some.reaching(0.6 * best), [c for c in cands if c[3] >= 0.6 * best]):
            judged = cm._judged(1, mine, 2.0) if any(c[2] > 0 for c in mine) else []
            rows.append(sorted(x for x in judged if x[-1] or known))
        assert rows[0] == rows[1]


def test_a_worker_holds_one_shard(spark):
    records = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lit("t "), F.col("id")).alias("title"), F.array(F.lit(7).cast("long"), F.col("id") + 100).alias("hs"), F.array(F.lit(1), F.lit(2)).alias("tf"))
    index = rt.write_index(records, {"k": "bigint", "title": "string"}, "k", 20)
    assert index.shards == 3
    ids = []
    for k in range(3):
        shard, (ks, titles) = index.shard(k)
        assert len(rt._loaded) == 1 and len(ks) == shard.size
        assert all(titles[r] == f"t {ks[r]}" for r in range(shard.size))
        ids += [ks[r] for r in range(shard.size)]
    assert sorted(ids) == list(range(60))
    found = []
    rt.search_all(index, [np.array([7, 142])], 0.9, lambda q, c, rec, sc: found.extend(c[0][k] for k in rec.tolist()))
    assert 42 in found


def test_mutual_nearest_rejects(spark):
    s = spark.createDataFrame(
        [(1, "Crystal growth rate of lysozyme in agitated vessels under low pressure", "10.1000/abc", "2001", [("Smith", "A", "author")])] + [(k, f"Other words {k} about topic {k * 7}", None, None, None) for k in range(2, 40)],
        "id long, title string, doi string, year string, creators array<struct<family:string,given:string,type:string>>",
    )
    d = spark.createDataFrame(
        [(1, "a.pdf", "# Crystal growth rate of lysozyme in agitated vessels under low pressure\n\nDOI: 10.1000/abc\n\nText here.", None), (2, "Crystal growth rate of lysozyme.pdf", None, None)],
        "id long, filename string, content string, source_id long",
    )
    rows = {(r.source_id, r.document_id): r.confidence for r in cm.match(s, d).collect()}
    # the second file states a short start of the title alone, far less than what the first one shares with the record
    assert set(rows) == {(1, 1)} and 0 < rows[1, 1] <= 1
    none = s.limit(0)
    assert cm.match(none, d).count() == 0 and cm.match(s, d.limit(0)).count() == 0


# --- 2: tree ---


def test_no_two_neighbours_fit_together():
    r = random.Random(1)
    bits = ["word ", "Sentence end. ", "\n", "\n\n", "# Head\n", "## Sub\n", "- item\n", "1.2 Title\n", "```\n", "<h2>T</h2>\n", "Top\n====\n", "| a | b |\n"]
    for _ in range(600):
        t = "".join(r.choice([*bits, "x" * r.randint(1, 60)]) for _ in range(r.randint(0, 60)))
        limit, overlap = r.randint(20, 150), r.randint(0, 30)
        out = pc.cut(t, limit, overlap)
        assert "".join(t[s:e] for _, s, e, _ in out) == t
        assert len(t) <= limit or all(0 < e - a <= limit for a, _, e, _ in out)
        room = limit - min(overlap, limit // 2)
        assert all(out[i + 1][2] - out[i][1] > room for i in range(len(out) - 1)) or len(out) == 1


def test_signs_in_a_fence_are_no_heading():
    t = "text before\n\n```\n# comment\n\nx = 1\n```\n\n" + "after words " * 20
    assert all(b != "heading" for *_, b in pc.cut(t, 80, 0))


# --- 6: edits ---


def test_misread_words_by_other_edits():
    f = pg.Repairer({"protein": 1000, "binding": 1000})
    assert [f.repair(w) for w in ("pr0tein", "bindlng", "protzin", "proein", "prrotein", "bindimg", "bindingg", "prtoein")] == ["protein", "binding", "protein", "protein", "protein", "binding", "binding", "protein"]
    assert f.repair("proteins") is None and f.repair("bindin") is None  # endings are no misreadings
    g = pg.Repairer({"protein": 1000, "binding": 1000, "of": 9000}, {("of", "protein"): 50})
    assert g.repair("protzin") is None and g.misread("protzin") is None and g.repair("protzin", "of") == "protein"


def test_words_judged_right_are_left_out_and_numbers_told_by_outer_signs():
    f = pg.Repairer({"protein": 1000, "binding": 1000})
    assert pg.examine("protein binding, protein", False, f) == (set(), None) and f.right == {"protein", "binding,"}
    assert pg.examine("protein pr0tein", False, f)[0] == {"ocr"} and "pr0tein" not in f.right
    assert pg.examine("binding, pr0tein", False, f)[0] == {"ocr"}
    r = random.Random(3)
    bits = ["12", "iv", "x", "L", " ", "  ", "\t", "|", "·", "Word", "٣", "\u2009", "-"]
    for _ in range(5000):
        line = "".join(r.choices(bits, k=r.randint(0, 8)))
        a, b = pg._number_beside(line, line.strip()), pg._beside.match(line)
        assert (a and a.groupdict()) == (b and b.groupdict())


# --- 9: classes ---


def test_alike_classes(spark):
    d = spark.createDataFrame([(1, "paypal"), (2, "pаypal"), (3, "paypal"), (4, "other"), (5, None), (6, "other")], "doc_id long, text string")
    assert sorted(map(tuple, la.alike_classes(d).collect())) == [(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3)]
