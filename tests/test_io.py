"""Readers, writers and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.sources import readers, writers
from paperloom.streaming import ingest


def test_documents_and_export(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text é")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    d = readers.documents(spark, str(tmp_path))
    assert {(r.filename, r.suffix, r.content) for r in d.collect()} == {("a.txt", ".txt", "text é"), ("b.pdf", ".pdf", None)}
    assert readers.pdf_listing(spark, str(tmp_path)).count() == 1
    assert readers.inline_document(spark, "note", "é").first().size_bytes == 2
    (tmp_path / "lib.json").write_text(json.dumps([{"title": "T"}, 3]))
    assert sorted(r.raw for r in readers.record_export(spark, str(tmp_path / "lib.json")).collect()) == ['3', '{"title":"T"}']


OBO = '[Term]\nid: X:1\nname: one\ndef: "d" [a]\nsynonym: "uno" EXACT []\nis_a: X:0 ! zero\n\n[Term]\nid: X:2\nname: two\n[Typedef]\nid: part_of\nname: part of\n'


def test_obo(spark):
    f = spark.createDataFrame([("o.obo", OBO)], "path string, value string")
    rows = {r.term_id: r for r in readers.obo_terms(f).collect()}
    assert set(rows) == {"X:1", "X:2"} and rows["X:1"].synonyms == ["uno"] and rows["X:1"].parents == ["X:0"]
    assert {r.term_id for r in readers.obo_terms(f, strict_compat=True).collect()} == {"X:1", "part_of"}


def test_tsv_and_triples(spark):
    tsv = "ID\tLABEL\tsynonyms\tSC %\nID\tA rdfs:label\tx\ty\nX:1\tone\tuno|ein; un\tX:0\n\ttwo\t\t\n"
    rows = readers.tsv_terms(spark.createDataFrame([("t.tsv", tsv)], "path string, value string")).collect()
    assert [(r.term_id, r.label, r.synonyms, r.parents) for r in rows] == [("X:1", "one", ["uno", "ein", "un"], ["X:0"]), ("two", "two", [], [])]
    t = [("http://x#C", "http://rdf#type", "http://owl#Class", "iri"), ("http://x#C", "http://rdfs#label", "see", "literal"), ("http://x#C", "http://rdfs#subClassOf", "http://x#B", "iri"), ("_:b", "http://rdfs#label", "blank", "literal")]
    r = readers.triple_terms(spark.createDataFrame(t, "s string, p string, o string, o_kind string")).collect()
    assert [(x.term_id, x.label, x.parents) for x in r] == [("C", "see", ["B"])]


def test_repository_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a.md", '---\ntitle: "T"\nyear: "2001"\n---\n\n# T'), ("b.md", "no front matter")], "file string, value string")
    assert writers.write_markdown(files, str(tmp_path / "repo")).count() == 2
    rows = {r.paper_id: r for r in readers.markdown_repository(spark, str(tmp_path / "repo")).collect()}
    assert rows["a"].title == "T" and rows["a"].error is None and rows["b"].error == "missing front matter"
    with pytest.raises(ValueError):
        writers.safe_target("/data/x", "../y")
    with pytest.raises(ValueError):
        writers.safe_target("/", "etc")


def test_audit_and_tsv(spark, tmp_path):
    e = spark.createDataFrame([("t", {"token": "s"})], "event string, details map<string,string>")
    writers.append_audit(e, str(tmp_path / "log"))
    writers.append_audit(e, str(tmp_path / "log"))
    assert [r.details.token for r in spark.read.json(str(tmp_path / "log")).collect()] == ["[REDACTED]"] * 2
    writers.write_tsv(spark.createDataFrame([('a\t"b"\nc',)], "x string"), str(tmp_path / "tsv"))
    assert spark.read.option("header", True).option("sep", "\t").option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "tsv")).first().x == 'a\t"b"\nc'


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 00:20:00"), (2, "b", "2024-01-01 03:00:00"), (3, "b", "2024-01-03 00:00:00")]
    src = spark.createDataFrame(rows, "id long, source string, ts string").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    schema = "id long, source string, ts timestamp"
    q = ingest.first_seen(ingest.document_stream(spark, str(tmp_path / "in"), schema), "id", "ts").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3
    q = ingest.arrivals(ingest.document_stream(spark, str(tmp_path / "in"), schema), "ts", "source").writeStream.outputMode("append").format("memory").queryName("arr").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.source, r.n) for r in spark.table("arr").collect()} == {("a", 2), ("b", 1)}

    def read():
        try:
            return spark.read.parquet(str(tmp_path / "out"))
        except Exception:
            return spark.createDataFrame([], schema)

    got = []
    q = ingest.upsert_stream(ingest.document_stream(spark, str(tmp_path / "in"), schema), read, lambda df, epoch: got.append((epoch, df.count())), lambda a, b: a.unionByName(b).dropDuplicates(["id"]), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert got == [(0, 3)]
