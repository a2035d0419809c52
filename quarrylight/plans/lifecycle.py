"""Answers to the engine's main questions, composed of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import top_directory
from quarrylight.operators import answers, catalog, extract, fusion, graph, lexical, packing
from quarrylight.runtime import cut


def file_links(files: DataFrame) -> DataFrame:
    """Resolved relations between files: graph (their generation), source, target, relation, line, confidence.

    A path names another file in each generation, so ends meet within one only.
    """
    edges = extract.edges(files).withColumn("target_symbol_id", F.lit(None).cast("string"))
    symbols = cut(extract.symbols(files))
    named = graph.resolve_names(edges, symbols).where("resolved_id IS NOT NULL")
    targets = symbols.select("generation_id", F.col("id").alias("resolved_id"), F.col("path").alias("target")).distinct()
    each = named.join(targets, ["generation_id", "resolved_id"]).where("source_path <> target")
    return each.groupBy(F.col("generation_id").cast("string").alias("graph"), F.col("source_path").alias("source"), "target", "relation").agg(F.min("line").alias("line"), F.max("resolved_confidence").alias("confidence"))


def overview(files: DataFrame, focus: str = "", budget: int = 4_000) -> DataFrame:
    """Repository map of each generation's files, chosen for a budget."""
    at = F.col("generation_id").cast("string").alias("graph")
    symbols = cut(extract.symbols(files).select(at, "path", "name", "kind"))
    ranks = graph.page_rank(files.select(at, F.col("path").alias("node")), file_links(files))
    terms = sorted({t.lower() for t in files.sparkSession.range(1).select(lexical.query_terms(F.lit(focus)).alias("t")).first()["t"]})
    entries = graph.repository_map(files.select(at, "path", "git_status"), symbols, ranks, terms)
    return graph.choose_map(entries, budget, focused=bool(terms))


def histograms(files: DataFrame) -> DataFrame:
    a = catalog.histogram(files, F.col("language")).select(F.lit("language").alias("what"), "value", "n")
    b = catalog.histogram(files, top_directory(F.col("path"))).select(F.lit("directory").alias("what"), "value", "n")
    return a.unionByName(b)


def retrieve(docs: DataFrame, questions: DataFrame, *, k: int = 20) -> DataFrame:
    """Evidence items of each question: best documents by terms, rescored and ready to be packed.

    ``questions``: query_id, query, route.
    """
    scored = lexical.bm25(docs, questions.select("query_id", "query"))
    best = lexical.top(scored.withColumn("score", F.round("score", 6)), k, "query_id", [F.desc("score"), F.col("doc_id")])
    rows = best.join(docs.select("doc_id", "title", "text"), "doc_id").join(questions, "query_id")
    base = fusion.heuristic_score(F.lit(1.0) / (60 + F.col("rank")), "factual_local", F.col("query"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.lit("chunk"), F.lit(False))
    return answers.query_excerpts(rows.withColumn("score", F.round(base, 9))).select(
        "query_id", "route", F.col("doc_id").cast("string").alias("id"), F.lit("chunk").alias("source_type"), F.col("doc_id").cast("string").alias("document_id"), "title",
        "snippet", "score", "rank", F.lit(True).alias("citable"),
    )


def evidence(docs: DataFrame, questions: DataFrame, *, k: int = 20) -> DataFrame:
    return packing.pack(retrieve(docs, questions, k=k))
