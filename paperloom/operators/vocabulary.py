"""Ontology term lists: lookup, search, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..session import cut_lineage
from .patterns import occurrences

#: Terms of a graph view.
GRAPH_TERMS = 80


def exact_lookup(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """J-10: (label, term_id): equal label keys, the first term in list order."""
    t = terms.where("label is not null").groupBy(tx.label_key("label").alias("k")).agg(F.min_by("term_id", "ord").alias("term_id"))
    return labels.select("label").where("label is not null").distinct().withColumn("k", tx.label_key("label")).join(t, "k").select("label", "term_id")


def _names(terms: DataFrame) -> DataFrame:
    names = terms.select("term_id", F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    return names.select("term_id", tx.label_key("name").alias("n")).where("n <> ''").distinct()


def contained_matches(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """R01, branches equal and contained only: (label, term_id, score) over labels and synonyms.

    Distinct names are looked for in distinct labels, and labels in names, by automata; no pair is
    compared that has no hit.
    """
    names = _names(terms)
    d = labels.select("label").distinct().withColumn("l", tx.label_key("label")).where("l <> ''")
    ls, ns = d.select("l").distinct(), names.select("n").distinct()
    hits = occurrences(ls.withColumn("t", F.col("l")), "l", "t", ns, "n").unionByName(occurrences(ns.withColumn("t", F.col("n")), "n", "t", ls, "l")).distinct()
    scored = hits.withColumn("score", F.when(F.col("l") == F.col("n"), 1.0).otherwise(0.85)).join(names, "n").groupBy("l", "term_id").agg(F.max("score").alias("score"))
    return d.join(scored, "l").select("label", "term_id", "score")


def search(terms: DataFrame, query: str, most: int = 50) -> DataFrame:
    """J-09/O02/P07: terms by their score for a query (label and synonyms), above the threshold, ties in list order; a blank query lists the first terms."""
    if not sim.fold(query):
        return terms.orderBy("ord").limit(most).select("ord", "term_id", "label", F.lit(None).cast("double").alias("score"))
    score = sim.local_scores(query)
    scored = terms.select("ord", "term_id", "label", score(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("score"))
    return scored.where(F.col("score") > sim.LEAST_SCORE).orderBy(F.desc("score"), "ord").limit(most)


def term_by_id(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, ord, term_id, label): the first term whose id or IRI is the one asked for."""
    keys = terms.select("ord", "term_id", "label", F.explode(F.array("term_id", "iri")).alias("wanted")).where("wanted is not null")
    return keys.join(wanted.select("wanted").distinct(), "wanted", "left_semi").groupBy("wanted").agg(F.min(F.struct("ord", "term_id", "label")).alias("t")).select("wanted", "t.*")


def graph(terms: DataFrame, most: int = GRAPH_TERMS) -> tuple[DataFrame, DataFrame]:
    """G01/J-11: nodes (id, label, placeholder) and edges (source, target, label) of the first terms.

    A parent outside the view becomes one placeholder node.
    """
    view = terms.orderBy("ord").limit(most)
    edges = view.select(F.col("term_id").alias("source"), F.explode("parents").alias("target"), F.lit("subClassOf").alias("label"))
    nodes = view.select(F.col("term_id").alias("id"), "label", F.lit(False).alias("placeholder"))
    missing = edges.select(F.col("target").alias("id")).distinct().join(nodes, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit(True).alias("placeholder"))
    return nodes.unionByName(missing), edges


def circle(nodes: DataFrame, radius: float = 240.0) -> DataFrame:
    """Positions on a circle by node order (a view of at most GRAPH_TERMS terms and their parents)."""
    w = Window.orderBy("id")
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    return nodes.select("id", (F.lit(radius) * F.cos(2 * F.pi() * i / n)).alias("x"), (F.lit(radius) * F.sin(2 * F.pi() * i / n)).alias("y"))


def ancestors(terms: DataFrame) -> DataFrame:
    """(term_id, ancestor, distance) up the parent links, each pair at its smallest distance, at any depth; cycles end."""
    up = cut_lineage(terms.select("term_id", F.explode("parents").alias("ancestor")).where("ancestor is not null").distinct())
    above = up.select(F.col("term_id").alias("ancestor"), F.col("ancestor").alias("higher"))
    known = step = up.withColumn("distance", F.lit(1))
    depth = 1
    while not step.isEmpty():
        depth += 1
        further = step.join(above, "ancestor").select("term_id", F.col("higher").alias("ancestor")).distinct()
        seen = known.select(F.col("term_id").alias("t"), F.col("ancestor").alias("a"))
        step = cut_lineage(further.join(seen, (F.col("term_id") == F.col("t")) & (F.col("ancestor") == F.col("a")), "left_anti").withColumn("distance", F.lit(depth)))
        known = cut_lineage(known.unionByName(step))
    return known


def simplified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view without placeholders, and without edges that lost an end."""
    kept = nodes.where(~F.col("placeholder"))
    ids = kept.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, e.select(*edges.columns)


def storage_rank(files: DataFrame, words: list[str]) -> DataFrame:
    """3 for a word in the file name, 3 in the name of its folder, 1 in the first page; positive scores only, best first, then by path.

    files: path, filename, content (pages parted by form feeds).
    """
    folder = F.lower(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    page = F.lower(F.split_part(F.coalesce("content", F.lit("")), F.lit("\f"), F.lit(1)))
    score = F.lit(0)
    for w in words:
        x = F.lit(w.lower())
        score = score + F.when(F.contains(F.lower("filename"), x), 3).otherwise(0) + F.when(F.contains(folder, x), 3).otherwise(0) + F.when(F.contains(page, x), 1).otherwise(0)
    return files.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "path")


def relevant_files(files: DataFrame, attachments: DataFrame) -> DataFrame:
    """(key, rank, path): the files of each attachment, the likeliest first.

    files: folder, path (PDF files below a storage folder named by the key); attachments: key, filename,
    path, title. An absolute PDF path wins alone; else the exact file name, the name behind ``storage:``,
    titles by shared words of more than two letters, then the others by name. Files of one folder are bounded by the folder.
    """
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    words = lambda c: F.filter(F.split(tx.slug(c, 1_000_000, ""), "-"), lambda w: F.length(w) > 2)
    a = attachments.select("key", F.lower(tx.strip(F.coalesce("filename", F.lit("")))).alias("fn"), F.coalesce("path", F.lit("")).alias("p"), words(F.coalesce("title", F.lit(""))).alias("tw"))
    linked = a.where(F.col("p").startswith("/") & F.lower("p").endswith(".pdf")).select("key", F.lit(1).alias("rank"), F.col("p").alias("path"))
    rest = a.join(linked.select("key"), "key", "left_anti").join(files.withColumnRenamed("path", "file"), F.col("key") == F.col("folder"))
    hint = F.when(F.lower("p").startswith("storage:"), name(F.substring("p", 9, 1_000_000))).otherwise("")
    shared = F.size(F.array_intersect("tw", words(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))))
    n = name(F.col("file"))
    tier = F.when((F.col("fn") != "") & (n == F.col("fn")), 0).when((hint != "") & (n == hint), 1).when(shared > 0, 2).otherwise(3)
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(tier, F.when(tier == 2, -shared).otherwise(0), n, "file")))
    return linked.unionByName(ranked.select("key", "rank", F.col("file").alias("path")))


def preferred_file(files: DataFrame, names: list[str]) -> DataFrame:
    """The one file to read: the first of the preferred names, else the first path."""
    at = F.array_position(F.array(*map(F.lit, names)), F.lower("name"))
    return files.orderBy(F.when(at > 0, at).otherwise(len(names) + 1), "path").limit(1)
