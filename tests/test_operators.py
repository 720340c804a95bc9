"""Segmentation, linking, upserts, dedupe, vocabulary on small cases."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from paperloom.functions import segments as sg
from paperloom.functions import similarity as sim
from paperloom.functions import structured as st
from paperloom.operators import exports, linking, pages, skew, vocabulary


def pack(text, most):
    if len(text) <= most:
        return [text] if text else []
    out, cur = [], ""
    for p in (x.strip() for x in text.split("\n\n") if x.strip()):
        if len(p) > most:
            out += [cur] if cur else []
            cur = ""
            out += [p[i : i + most] for i in range(0, len(p), most)]
            continue
        joined = f"{cur}\n\n{p}" if cur else p
        if len(joined) > most:
            out.append(cur)
            cur = p
        else:
            cur = joined
    return out + ([cur] if cur else [])


def test_packing_against_loop(spark):
    r = random.Random(3)
    texts = ["", "a" * 40, "a" * 41] + ["\n\n".join("w" * r.randint(0, 60) for _ in range(r.randint(1, 9))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sg.pack_paragraphs(F.col("t"), 40).alias("c"))
    for row in d.collect():
        assert row.c == pack(texts[row.i], 40)


def test_section_tree(spark):
    text = "Intro words here\n1. First\nbody one\n1.1 Child\nbody two\nbody three\n2. Second\nlast"
    rows = sg.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, content string"), "id").orderBy("section_no").collect()
    got = [(r.section_no, r.parent_no, r.level, r.heading, r.text) for r in rows if r.id == 1]
    assert got == [(0, None, 0, "Front matter", "Intro words here"), (1, None, 1, "First", "body one"), (2, 1, 2, "Child", "body two body three"), (3, None, 1, "Second", "last")]


def test_look_ahead_heading(spark):
    text = "Solution Processing Framework\nThis line has more than five words in it\nplain words without case\nshort"
    rows = sg.sections(spark.createDataFrame([(1, text)], "id long, content string"), "id").collect()
    assert {r.heading for r in rows} == {"Solution Processing Framework"}


def test_claims(spark):
    s = [("p", 1, "Results", 1, 2, "We measured the solubility of many proteins in water. Short one. Nothing of interest happens in this long sentence here."), ("p", 2, "References", 3, 3, "We found that nobody reads the long list of cited works.")]
    d = spark.createDataFrame(s, "paper_key string, section_no int, heading string, page_start int, page_end int, text string")
    rows = sg.claims(d).collect()
    assert [(r.claim_id, r.type, r.pages) for r in rows] == [("p_claim_0001", "result", "1-2")]


def test_header_footer(spark):
    p = [(1, k, k, f"Journal of X\nbody {k} é\nunique {k}\n{k}") for k in range(1, 4)] + [(2, 9, 1, "Only page"), (2, 10, 2, None)]
    d = spark.createDataFrame(p, "doc_id long, page_id long, page_number int, text string")
    got = {r.page_id: r.text for r in pages.strip_headers_footers(d).collect()}
    assert got == {1: "body 1 é\nunique 1", 2: "body 2 é\nunique 2", 3: "body 3 é\nunique 3", 9: "Only page"}


def sequential(papers):
    seen, kept = set(), []
    for p, ks in papers:
        if not set(ks) & seen:
            kept.append(p)
            seen |= set(ks)
    return kept


def test_greedy_dedupe(spark):
    cases = [[("A", ["x"]), ("B", ["x", "y"]), ("C", ["y"]), ("D", [])]]
    r = random.Random(1)
    for _ in range(4):
        cases.append([(f"p{i:02d}", r.sample("abcdefghijkl", r.randint(0, 3))) for i in range(30)])
    for papers in cases:
        d = spark.createDataFrame([(p, i, ks) for i, (p, ks) in enumerate(papers)], "p string, o int, ks array<string>")
        assert sorted(x.p for x in linking.greedy_dedupe(d, "p", "o", "ks").collect()) == sorted(sequential(papers))


SOURCE = "id long, provider string, provider_item_key string, citation_key string, title string, normalized_title string, creators array<struct<family:string,given:string,type:string>>, year string, normalized_doi string, doi string, url string, abstract string, item_type string"
INCOMING = "row_id long, provider_item_key string, citation_key string, title string, item_type string, creators array<struct<family:string,given:string,type:string>>, year string, doi string, url string, abstract string"


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "zotero", "K1", "ck1", "Old", "old", None, "1999", "10.1/a", "10.1/a", None, "abs", None)], SOURCE)
    inc = [(1, "K1", None, "New title", None, None, "2001", None, None, None), (2, None, None, "Twice", None, None, None, None, None, None), (3, None, None, "Twice", None, None, None, None, None, None)]
    rows = {r.id: r for r in linking.upsert(stored, spark.createDataFrame(inc, INCOMING)).collect()}
    assert rows[1].outcome == "updated" and rows[1].citation_key == "ck1" and rows[1].abstract is None and rows[1].title == "New title"
    assert [rows[k].outcome for k in (3, 4)] == ["inserted", "inserted"]  # equal new rows of one batch


def test_link(spark):
    s = [(1, "zotero", None, "smith2001x", "T", "a study of crystal growth in water", None, None, None, None, None, None, None), (2, "zotero", None, None, "T", "a study of crystal growth in water", None, None, None, None, None, None, None), (3, "zotero", None, None, "T", "another title about five words", None, None, "10.1234/zz", None, None, None, None)]
    d = [(1, "Smith2001x.pdf", None, None), (2, "f.pdf", "see A Study of Crystal Growth, in water!", None), (3, "f.pdf", "doi:10.1234/ZZ.", None), (4, "f.pdf", "nothing", None), (5, "f.pdf", "doi:10.1234/ZZ", 9)]
    docs = spark.createDataFrame(d, "id long, filename string, content string, source_id long")
    got = {r.id: (r.source_id, r.outcome) for r in linking.link_documents(docs, spark.createDataFrame(s, SOURCE)).collect()}
    assert got == {1: (1, "linked"), 2: (None, "ambiguous"), 3: (3, "linked"), 4: (None, "skipped"), 5: (9, "skipped")}
    assert {r.id: r.source_id for r in linking.link_documents(docs, spark.createDataFrame(s, SOURCE), force=True).collect()}[5] == 3


def test_skew_helpers(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id long, k string")
    heads = skew.group_heads(left, "k", "id")
    assert [(r.k, r.head_id, r.copies) for r in heads.collect()] == [("hot", 1, 40)]
    assert skew.with_group_head(left, "k", "id").count() == 40
    right = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.join_on_unique(left, right, "k", "n", hot_keys=1).count() == 60


def test_similarity_rules(spark):
    assert sim.local_score("Tide", ["diet"]) == 0.25  # asymmetric: the other way round it is 0.5
    assert sim.local_score("Cell growth", ["cell  GROWTH"]) == 1.0
    assert sim.local_score("growth", ["cell growth"]) >= 0.85
    assert sim.external_score("growth", "cell growth") == 0.85
    assert round(SequenceMatcher(None, "tide", "diet").ratio(), 3) == sim.external_score("tide", "diet")


def test_term_matcher_is_exact(spark):
    r = random.Random(2)
    words = ["protein", "crystal", "growth", "rate", "heat", "sheet", "step", "yield", "ß-sheet", "a"]
    terms = [(f"t{i}", [" ".join(r.sample(words, r.randint(1, 3))) for _ in range(r.randint(1, 3))]) for i in range(60)]
    m = sim.TermMatcher(terms)
    for _ in range(60):
        label = " ".join(r.sample(words, r.randint(1, 3)))
        full = [(sim.local_score(label, ns), -k) for k, (_, ns) in enumerate(terms)]
        want = [(-k, s) for s, k in sorted(full, reverse=True)[:5] if s > 0.35]
        assert m.top([label]) == want


def test_vocabulary(spark):
    t = spark.createDataFrame([(1, "T1", "Root", None, []), (2, "T2", "Child", ["kid"], ["T1"]), (3, "T3", "Leaf", [], ["T2", "X9"])], "ord int, term_id string, label string, synonyms array<string>, parents array<string>")
    nodes, edges = vocabulary.graph(t)
    assert {(r.id, r.placeholder) for r in nodes.collect()} == {("T1", False), ("T2", False), ("T3", False), ("X9", True)}
    assert edges.count() == 3
    assert {(r.term_id, r.ancestor, r.distance) for r in vocabulary.ancestors(t).collect()} >= {("T3", "T1", 2), ("T3", "T2", 1)}
    labels = spark.createDataFrame([("a kid toy",), ("root",), (None,), ("-",)], "label string")
    assert {(r.label, r.term_id, r.score) for r in vocabulary.contained_matches(labels, t).collect()} == {("a kid toy", "T2", 0.85), ("root", "T1", 1.0)}


def test_contracts(spark):
    raw = [
        ('{"candidates":[{"label":" ","confidence_score":1.1,"evidence":[]}]}', ["blank_label", "score_range", "no_evidence"]),
        ('{"candidates":[{"label":"x","confidence_score":0.5,"evidence":[{"quoted_text":" ","direct_or_inferred":"maybe"}]}]}', ["blank_quote", "bad_mode"]),
        ('{"candidates":[], "extra":1}', None), ("{broken", None),
    ]
    d = spark.createDataFrame([(r, i) for i, (r, _) in enumerate(raw)], "raw string, i int").select("i", st.parse_candidates(F.col("raw")).alias("c"))
    for r in d.select("i", "c", F.transform("c", st.candidate_violations).alias("v")).collect():
        want = raw[r.i][1]
        assert (r.v[0] if r.v else None) == want


def test_front_matter_and_sections(spark):
    text = '---\ntitle: "First"\ntags:\n  - "a b"\n  - c\ntitle: "Last"\nyear: 2001\n---\n\n## Abstract\nshort\n\n## Notes\n### One\nx\n### Two\ny\n'
    b = st.front_matter(F.col("v"))
    r = spark.createDataFrame([(text,)], "v string").select(st.front_matter_value(b, "title").alias("t"), st.front_matter_list(b, "tags").alias("l"), st.markdown_section(F.col("v"), "abstract").alias("a"), st.markdown_section(F.col("v"), "Notes").alias("n")).first()
    assert (r.t, r.l, r.a) == ("Last", ["a b", "c"], "short")
    subs = st.subsections(spark.createDataFrame([(1, r.n), (2, "none")], "id int, t string"), "id", "t")
    assert {(x.id, x.heading, x.text) for x in subs.collect()} == {(1, "One", "x"), (1, "Two", "y"), (2, None, "none")}


def test_exports(spark):
    p = spark.createDataFrame([('A "q"', "2001", None, "", "abs", [("H", "t"), ("E", "")])], "title string, year string, doi string, citation string, abstract string, sections array<struct<heading:string,text:string>>")
    v = exports.paper_markdown(p).first().value
    assert v == '---\ntitle: "A \\"q\\""\nyear: "2001"\n---\n\n# A "q"\n\n## Abstract\n\nabs\n\n## Notes\n\n\n\n## Extracted ontology-relevant information\n\n### H\n\nt\n'
