"""Sections, chunks, records, stored rows and patterns on small cases, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import records as rc
from paperloom.functions import sections as sc
from paperloom.functions import similarity as sim
from paperloom.functions import structured as st
from paperloom.operators import linking, papers, review, skew, vocabulary
from paperloom.sources import readers


def test_structured_sections():
    rows = sc.structured([(1, "Title here\n1. Introduction\nbody a\n1.1 Part\nx\n1.1.1 Deep\ny"), (2, "2 Methods\nq\n1990, a list\nReferences\n[1]")])
    assert [(r["level"], r["heading"], r["parent_no"], r["section_order"]) for r in rows] == [
        (0, "Front matter", None, 0.0), (1, "Introduction", None, 1.0), (2, "Part", 1, 1.1), (3, "Deep", 2, 1.1), (1, "Methods", None, 2.0), (1, "References", None, 3.0),
    ]
    assert rows[4]["body"] == ["q", "1990, a list"]
    assert sc.structured([]) == [] and sc.structured([(1, "   ")]) == []


def test_raw_and_page_sections():
    rows = sc.raw_sections("Abstract\nwhat\n1 Results\nr\n1.2 More\nm\nReferences\nx")
    assert [(r["heading"], r["level"], r["parent_no"]) for r in rows] == [("Abstract", 1, None), ("Results", 1, None), ("More", 2, 1)]
    assert [r["heading"] for r in sc.raw_sections("no heading at all")] == ["Full text"]
    rows = sc.page_tree([(3, "intro line\n1 First\na"), (4, "Figure 2. caption\nb\n2.1 Sub\nc")])
    assert [(r["heading"], r["level"], r["parent_no"]) for r in rows] == [("Paper body", 2, None), ("1 First", 2, None), ("Figure 2", 3, 1), ("2.1 Sub", 3, 1)]


def naive_chunks(pages, target, most):
    out, cur, first, label = [], [], None, "unknown"
    size = lambda ps: max(1, round(len("\n\n".join(ps)) / 4))
    for n, t in pages:
        for p in [x.strip() for x in t.split("\n\n") if x.strip()]:
            label = sc._label(p) or label
            if cur and size([*cur, p]) > most:
                out.append((label, first, n, "\n\n".join(cur)))
                cur, first = [p], n
            else:
                first = n if not cur else first
                cur.append(p)
            if size(cur) >= target:
                out.append((label, first, n, "\n\n".join(cur)))
                cur, first = [], None
    return out + ([(label, first, pages[-1][0], "\n\n".join(cur))] if cur else [])


def test_page_chunks_against_loop():
    r = random.Random(5)
    for _ in range(60):
        pages = [(n, "\n\n".join(r.choice(["Results", "2 Part", "w " * r.randint(1, 60), ""]) for _ in range(r.randint(0, 6)))) for n in range(1, r.randint(2, 6))]
        assert sc.chunks_of_pages(pages, 20, 30) == naive_chunks(pages, 20, 30)


def naive_context(text, most):
    out, cur = [], ""
    for p in text.split("\n\n"):
        joined = f"{cur}\n\n{p}".strip() if cur else p
        if len(joined) <= most:
            cur = joined
            continue
        out += [cur] if cur else []
        cur = ""
        if len(p) > most:
            out += [p[i : i + most] for i in range(0, len(p), most)]
        else:
            cur = p
    return out + ([cur] if cur else [])


def test_context_packing_against_loop(spark):
    r = random.Random(7)
    texts = ["", "x" * 31] + ["\n\n".join("w" * r.randint(0, 50) for _ in range(r.randint(1, 7))) for _ in range(40)]
    for row in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sc.pack_context(F.col("t"), 30).alias("c")).collect():
        assert row.c == naive_context(texts[row.i], 30), texts[row.i]
    with pytest.raises(ValueError):
        sc.context_room(1000, 500)


def test_markdown_of_lines(spark):
    d = spark.createDataFrame([(["1. Introduction", "first line", "goes on", "", "A B S T R A C T", "text", "Fig. 3. A caption"],)], "ls array<string>")
    assert d.select(sc.lines_to_markdown(F.col("ls")).alias("m")).first().m == [
        "## 1. Introduction", "", "first line goes on", "", "## ABSTRACT", "", "text", "", "### Fig. 3. A caption", "",
    ]


def test_section_map(spark):
    d = spark.createDataFrame([("Abstract\nshort\n1 Methods\nhow\nFindings\nwhat", None), ("plain text", "given"), ("plain text", None), (None, None)], "t string, a string")
    got = [r.m for r in d.select(sc.section_map("t", "a").alias("m")).collect()]
    assert got == [{"abstract": "short", "methodology": "how", "results": "what"}, {"abstract": "given"}, {"introduction": "plain text"}, {}]


def test_records(spark):
    api = '{"key":"K1","version":"7","data":{"title":" T ","itemType":"book","creators":[{"lastName":"A","firstName":"B"},"x",{"name":"C"}],"date":"June 2001","extra":"x\\n citation key: abc ","tags":[{"tag":"t"},"u",{"tag":" "}]}}'
    own = '{"id":"","key":"K2","title":"S","author":[{"family":"F"}],"issued":{"date-parts":[[1999]]},"DOI":"https://doi.org/10.1000/X."}'
    rows = [(1, api), (2, own), (3, "{"), (4, "[1]"), (5, '{"data":{"title":"n","itemType":"note"}}'), (6, '{"title":" "}'), (7, None)]
    got = {r.i: r for r in rc.source_records(spark.createDataFrame(rows, "i int, raw string"), "i").collect()}
    assert set(got) == {1, 2}
    assert (got[1].title, got[1].citation_key, got[1].year, got[1].version, got[1].tags) == ("T", "abc", "2001", 7, ["t", "u"])
    assert [(c.family, c.given, c.type) for c in got[1].creators] == [("A", "B", "author"), (None, None, "author")]
    assert (got[2].provider_item_key, got[2].year, got[2].doi) == ("K2", "1999", "10.1000/x")
    link = '<https://x.example/items?start=100>; rel="next", <https://x.example/items>; rel="last"'
    assert spark.createDataFrame([(link,), ("",)], "h string").select(rc.next_link(F.col("h")).alias("n")).collect()[0].n == "https://x.example/items?start=100"


def test_contracts(spark):
    full = '{"suggestion_type":"x","proposed_label":"l","existing_ontology_id":null,"proposed_definition":null,"synonyms":[],"parent_class":null,"relations":[],"source_literature_ids":[],"supporting_quotes_or_summaries":[],"confidence":%s,"rationale":"r"}'
    cases = [full % "1", full % '"0.5"', full % "1.2", '{"confidence":true}', None]
    got = [r.p for r in spark.createDataFrame([(c,) for c in cases], "raw string").select(st.suggestion_problems(F.col("raw")).alias("p")).collect()]
    assert got[:3] == [[], ["confidence"], ["confidence"]] and len(got[3]) == 10 and got[4] is None
    whole = ["{", "[]", '{"suggestions":1}', '{"suggestions":[],"warnings":"w"}', '{"suggestions":[' + full % "0.5" + ',"x"]}']
    got = [r.p for r in spark.createDataFrame([(c,) for c in whole], "raw string").select(st.response_problems(F.col("raw")).alias("p")).collect()]
    assert got == [["malformed"], ["not_an_object"], ["no_suggestions_list"], ["warnings_not_a_list"], ["2 not_an_object"]]
    runs = spark.createDataFrame([(1, 2, '{"suggestions":[' + full % "0.1" + "]}"), (1, 1, '{"suggestions":[],"warnings":["w"]}'), (1, 3, "{")], "run int, n int, raw string")
    agg = st.aggregated_responses(runs, "run", "n").first()
    assert len(agg.suggestions) == 1 and agg.warnings == ["w"]


def test_links_in_one_pass_and_by_joins(spark):
    docs = spark.createDataFrame(
        [(1, "mysmith2020x.pdf", "nothing", None), (2, "a.txt", "On protein folding and unfolding rates of lysozyme in water", None), (3, "b.txt", "doi 10.1000/abc here", None), (4, "c.txt", None, 9), (5, "ab", "x", None), (6, None, "the the title of many words is here indeed ok", None)],
        "id long, filename string, content string, source_id long",
    )
    src = spark.createDataFrame(
        [(10, "Smith2020", None, "zz"), (11, None, None, "rotein fold"), (12, None, "10.1000/abc", ""), (13, "ab", None, None), (14, None, None, "the title of many words is here"), (15, None, None, "the title of many words is here")],
        "id long, citation_key string, normalized_doi string, normalized_title string",
    )
    one = {r.id: (r.source_id, r.outcome) for r in linking.link_documents(docs, src).collect()}
    two = {r.id: (r.source_id, r.outcome) for r in linking.link_documents(docs, src, most=10).collect()}
    assert one == two == {1: (10, "linked"), 2: (11, "linked"), 3: (12, "linked"), 4: (9, "skipped"), 5: (13, "linked"), 6: (None, "ambiguous")}


def test_titles_are_found_without_moving_texts(spark):
    r = random.Random(7)
    words = ["a", "kinetic", "model", "for", "growth", "", "of", "x"]
    titles = sorted({" ".join(r.choices(words, k=r.randint(5, 9))) for _ in range(300)} - {""})
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))) + r.choice(["", "\n" + r.choice(titles), "pre" + r.choice(titles) + "post"]) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    long = spark.createDataFrame([(t, k, k) for k, t in enumerate(titles)], "key string, lo long, hi long")
    want = {(i, k) for i, x in enumerate(texts) for k, t in enumerate(titles) if t in x}
    for most in (10**6, 100):
        found = linking._long_titles(d, long, most)
        assert {(x.id, x.lo) for x in found.collect()} == want and want
    # of a text that has the common words of all titles, but no title, nothing is moved
    one = spark.createDataFrame([("on the growth rate of many crystals", 1, 1)], "key string, lo long, hi long")
    near = spark.createDataFrame([(1, "on the growth rate of few crystals " * 50), (2, "xon the growth rate of many crystalsx")], "id long, text string")
    assert [x.id for x in linking._long_titles(near, one).collect()] == [2]
    plan = linking._long_titles(near, one)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "text" in line for line in plan.splitlines())


def test_best_ratios_against_all_pairs(spark):
    r = random.Random(2)
    words = ["crystal", "growth", "rate", "of", "protein", "in", "water", "seed", "mixing"]
    titles = [" ".join(r.choices(words, k=r.randint(3, 14))) for _ in range(40)] + [""]
    stored = [(t[: r.randint(1, len(t))] + r.choice(["", " x", " rate"]), k) for k, t in enumerate(titles[:-1])] + [(" ".join(r.choices(words, k=6)), 90 + k) for k in range(20)]
    stored = list({k: o for k, o in stored}.items())
    want = {}
    for t in titles:
        score, neg = max((sim.ratio(t, g), -o) for g, o in stored)
        if score >= 0.7:
            want[t] = (score, -neg)
    got = sim.best_ratios(spark.createDataFrame([(t,) for t in set(titles)], "key string"), spark.createDataFrame(stored, "key string, ord long"), 0.7)
    assert {x.key: (x.score, x.ord) for x in got.collect()} == want


def test_terms_with_synonyms_in_parts(spark, monkeypatch):
    labels = spark.createDataFrame([("zz", ["seed crystal"]), ("seed", None)], "label string, synonyms array<string>")
    terms = spark.createDataFrame([(1, "T1", "seed crystal", []), (2, "T2", "seed", ["germ"]), (3, "T3", "feed", None)], "ord long, term_id string, label string, synonyms array<string>")
    whole = sorted(map(tuple, sim.match_terms(labels, terms).drop("synonyms").collect()))
    assert ("zz", 1, "T1", 1.0, "exact_or_synonym") in whole
    monkeypatch.setattr(sim, "MAX_NAMES", 1)
    assert sorted(map(tuple, sim.match_terms(labels, terms).drop("synonyms").collect())) == whole


def test_vocabulary(spark):
    terms = spark.createDataFrame([(k, f"T{k}", f"i{k}", f"n{k}", [], [f"T{k - 1}"] if k else ["T30"]) for k in range(31)], "ord int, term_id string, iri string, label string, synonyms array<string>, parents array<string>")
    up = vocabulary.ancestors(terms)
    assert up.count() == 31 * 31 and up.agg(F.max("distance")).first()[0] == 31  # a cycle, deeper than 20
    assert [r.term_id for r in vocabulary.search(terms, "n7").take(1)] == ["T7"] and vocabulary.search(terms, " ", 5).count() == 5
    f = spark.createDataFrame([("/a/x/paper.pdf", "paper.pdf", "q"), ("/paper/y.txt", "y.txt", "paper"), ("/a/z.txt", "z.txt", "p1\fpaper")], "path string, filename string, content string")
    assert [(r.filename, r.score) for r in vocabulary.storage_rank(f, ["Paper"]).collect()] == [("y.txt", 4), ("paper.pdf", 3)]


def test_stored_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0.5), (2, "b", None, 0.1)], "id int, label string, parent string, score double")
    ch = spark.createDataFrame([(1, 1, {"label": "c", "score": None}), (1, 2, {"label": "d"}), (2, 1, {"parent": None, "nope": "1"}), (9, 1, {"label": "q"})], "id int, ord int, fields map<string,string>")
    assert sorted(map(tuple, review.patched(rows, ch, "id", ("parent",)).collect())) == [(1, "d", "x", 0.5), (2, "b", None, 0.1)]
    s = spark.createDataFrame([(1, "ready"), (2, "ready"), (3, None)], "id int, state string")
    out = spark.createDataFrame([(1, 1, "ok"), (1, 2, "sent"), (2, 1, "sent"), (3, 1, "ok")], "id int, seq int, outcome string")
    steps = {("ready", "ok"): "built", ("built", "sent"): "done"}
    assert sorted(map(tuple, review.transitioned(s, out, "id", "state", steps).collect())) == [(1, "done"), (2, "ready"), (3, None)]
    assert review.transitioned(s, out, "id", "state", steps, dry_run=True) is s
    r = spark.createDataFrame([(1, None, "keep"), (2, "m", "used"), (3, "m", "other")], "id int, m string, decision string")
    c = spark.createDataFrame([(1, "new"), (2, None), (3, None)], "id int, match string")
    assert sorted(map(tuple, review.selected(r, c, "id", "m", "decision", "used", "open").collect())) == [(1, "new", "used"), (2, None, "open"), (3, None, "other")]
    q = spark.createDataFrame([(1, "a", "b", None, None)], "id int, s string, d string, why string, at string")
    o = spark.createDataFrame([(1, True, "bad", "t")], "id int, close boolean, reason string, at string")
    assert tuple(review.closed(q, o, "id", "s", "d", "why", "at", ("out", "no"), ("in", "open")).first()) == (1, "out", "no", "bad", "t")
    got = review.called(spark.createDataFrame([("a",), ("",)], "prompt string"), lambda p: str(1 // len(p))).collect()
    assert got[0].raw == "1" and got[1].raw is None and got[1].error
    kept = papers.put_settings(spark.createDataFrame([("k", "v")], "key string, value string"), spark.createDataFrame([("k", None, 1), ("n", "w", 2)], "key string, value string, ord int"))
    assert sorted(map(tuple, kept.collect())) == [("k", "v"), ("n", "w")]


def test_names_and_positions(spark):
    d = spark.createDataFrame([(k, "same.pdf" if k % 3 else f"o{k}") for k in range(300)], "i int, n string")
    got = {r.i: r.unique_name for r in linking.unique_names(d, "n", "i").collect()}
    seen = {}
    for k in range(300):
        n = "same.pdf" if k % 3 else f"o{k}"
        c = seen.get(n, 0)
        seen[n] = c + 1
        assert got[k] == (n if c == 0 else f"same_{c}.pdf")
    pos = skew.numbered(d.select("i"), "i", "p").collect()
    assert sorted((r.i, r.p) for r in pos) == [(k, k + 1) for k in range(300)]
    new = linking.new_rows(spark.createDataFrame([("a", None)], "x string, y int"), spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "b", 1), (4, None, None)], "i int, x string, y int"), ["x", "y"], "i")
    assert sorted(r.i for r in new.collect()) == [2, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    got = {r.filename: r.content for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "ok � end", "b.bin": None}
    e = tmp_path / "e"
    e.mkdir()
    (e / "1.json").write_text('[{"a":1},"x"]')
    (e / "2.json").write_text("{bad")
    (e / "3.json").write_text("{}")
    rows = readers.record_export(spark, str(e)).collect()
    assert sorted((r.pos, r.raw, r.error) for r in rows if r.error is None) == [(0, '{"a":1}', None), (1, "x", None)]
    assert sorted(r.error for r in rows if r.error) == ["malformed JSON", "not a list"]
    m = tmp_path / "m"
    m.mkdir()
    (m / "p.md").write_text('---\ntitle: "T"\nauthors:\n  - "A"\n  - "B"\n---\n\n# T\n\n## Abstract\n\nabs\n\n## Extracted ontology-relevant information\n\n### H1\n\nx\n\n### H2\n\ny\n')
    (m / "q.md").write_text("no front matter")
    p = {r.paper_id: r for r in readers.markdown_repository(spark, str(m)).collect()}
    assert p["p"].authors == ["A", "B"] and p["p"].abstract == "abs" and [(s.heading, s.text) for s in p["p"].sections] == [("H1", "x"), ("H2", "y")]
    assert p["q"].error == "missing front matter"
    pages = readers.pdf_pages(spark.createDataFrame([("f", bytearray(b"a|b")), ("g", bytearray(b""))], "path string, content binary"), lambda b: b.decode().split("|") if b else 1 / 0).collect()
    assert [(r.path, r.page_number, r.text) for r in pages] == [("f", 1, "a"), ("f", 2, "b"), ("g", 0, None)] and pages[2].error
    with pytest.raises(ValueError):
        readers.ontology_terms(spark, "x.doc")
