"""Fusion of ranked lists and heuristic rescoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import contradicts, overlap

#: Weight of a source type on a route; all others weigh 1.
ROUTE_WEIGHTS = {
    "exact": {"chunk": 1.15, "proposition": 1.05, "summary": 0.85},
    "factual_local": {"chunk": 1.12, "proposition": 1.08, "summary": 0.9},
    "multi_hop": {"chunk": 1.1, "proposition": 1.1, "summary": 0.9, "graph_edge": 0.8},
    "global": {"chunk": 0.88, "proposition": 1.0, "summary": 1.25},
    "argumentative": {"chunk": 1.0, "proposition": 1.22, "summary": 0.95, "graph_edge": 1.08},
    "visual": {"chunk": 1.0, "proposition": 0.92, "summary": 1.05, "visual_page": 1.3},
}
RESULT_LIMITS = {"exact": 8, "factual_local": 10, "multi_hop": 20, "global": 8, "argumentative": 12, "visual": 8}
PHRASES = ("exact", "uuid", "codigo", "definition", "defines")


def reciprocal_ranks(lists: list[DataFrame], key: list[str], *, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Key and score: the sum over the lists of weight / (constant + rank).

    Each list holds the key columns and ``rank``. ``first_list`` and
    ``first_rank`` say where a key was first seen; they break ties.
    """
    weights = weights or [1.0] * len(lists)
    rows = reduce(
        DataFrame.unionByName,
        [x.select(*key, "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("weight")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))],
    )
    return (
        rows.groupBy(*key)
        .agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
        .select(*key, "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))
    )


def focus_fusion(hits: DataFrame) -> DataFrame:
    """Paths over several facets (facet, path, rank, score): constant 10, the first facet weighs 0.85 if there are others."""
    best = hits.groupBy("facet", "path").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    facets = hits.agg(F.count_distinct("facet").alias("facets"))
    weight = F.when((F.col("facet") == 0) & (F.col("facets") > 1), 0.85).otherwise(1.0)
    return best.crossJoin(F.broadcast(facets)).groupBy("path").agg(  # one row
        F.sum(weight / (10 + F.col("rank"))).alias("fused"), F.count("*").alias("appearances"), F.max("score").alias("best")
    )


def route_weight(route: str, source_type: Column) -> Column:
    weight = F.lit(1.0)
    for kind, w in ROUTE_WEIGHTS.get(route, {}).items():
        weight = F.when(source_type == kind, F.lit(w)).otherwise(weight)
    return weight


def heuristic_score(score: Column, route: str, query: Column, title: Column, snippet: Column, source_type: Column, has_heading: Column, neural: Column | None = None) -> Column:
    """Score after overlap, phrase, contradiction and heading bonuses, times the route's weight."""
    text = F.concat_ws(" ", title, snippet)
    shared = overlap(query, text)
    bonus = F.when(has_heading, 0.08).otherwise(0.0)
    if route == "exact":
        bonus += F.when(F.lower(F.concat_ws(" ", snippet, title)).rlike("|".join(PHRASES)), 0.15).otherwise(0.0)
    if route == "argumentative":
        bonus += F.when(contradicts(snippet), 0.12).otherwise(0.0)
    base = score + 0.35 * shared if neural is None else neural + 0.1 * score + 0.2 * shared
    return (base + bonus) * route_weight(route, source_type)


def dense_sparse(dense: DataFrame, sparse: DataFrame, key: list[str]) -> DataFrame:
    """Fused score of dense and sparse ranks (0.65 and 0.35 over 60 + rank).

    A hit that both lists hold is visited twice, and each visit adds both terms;
    ``visits`` is returned for further bonuses that count alike.
    """
    d = dense.select(*key, F.col("rank").alias("dense_rank"))
    s = sparse.select(*key, F.col("rank").alias("sparse_rank"))
    both = d.join(s, key, "full_outer")
    visits = F.col("dense_rank").isNotNull().cast("int") + F.col("sparse_rank").isNotNull().cast("int")
    term = lambda rank, w: F.coalesce(F.lit(w) / (60 + F.col(rank)), F.lit(0.0))
    return both.select(*key, "dense_rank", "sparse_rank", visits.alias("visits"), (visits * (term("dense_rank", 0.65) + term("sparse_rank", 0.35))).alias("score"))
