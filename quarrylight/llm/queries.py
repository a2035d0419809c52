"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import credentials, encode, handwritten, language, leaks, rank_merge, scans
from quarrylight.llm.syntax import check as syntax
from quarrylight.runtime import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files")).select("generation_id", "path").distinct()


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every file with the probability that it is handwritten."""
    return handwritten.beliefs(table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_merge.top_candidates(
        table(spark, sf_dir, "repomap_entries"), table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "ranking_queries")
    ).select("query_id", "generation_id", "path")


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credentials(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credentials(spark, sf_dir).select("origin", "generation_id", "record_key", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that held credentials, with these masked."""
    return _credentials(spark, sf_dir).where("redacted IS NOT NULL").select("origin", "generation_id", "record_key", "redacted").distinct()


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "document_nodes").select("id", "document_id", "node_type", "page_number", "order_index", "raw_text", "metadata", "ingested_at")
    return scans.repair(nodes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("id", F.explode("kinds").alias("kind"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous readable text of each body node."""
    return scans.continuous(cut(_repaired(spark, sf_dir)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "files")).select("generation_id", "path").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, sf_dir, "files"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), leaks.golden_passages(table(spark, sf_dir, "golden_cases")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: how many documents hold it, its longest verbatim run, and where that begins."""
    best = F.max(F.struct("longest_run", (-F.col("doc_id")).alias("d"), "doc_word", "item_word"))
    rows = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), best.alias("b"))
    return rows.select("item_id", "documents", "b.longest_run", (-F.col("b.d")).alias("doc_id"), "b.doc_word", "b.item_word")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id"), _leaks(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return language.wrong_labels(language.languages(docs, language.fit_filter(docs)))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recognised sentence with its language and confidence."""
    docs = _texts(spark, sf_dir)
    return language.segments(docs, language.fit_filter(docs)).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {
    "p1_found": p1_found,
    "p1_labels": p1_labels,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p6_found": p6_found,
    "p6_texts": p6_texts,
    "p7_found": p7_found,
    "p7_rates": p7_rates,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}

_RANKED = """
WITH own AS (
  SELECT query_id, generation_id, path, max(score) AS s1, max(centrality) AS s2, max(focus_score) AS s3
  FROM (SELECT query_id, generation_id, path, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
               CASE WHEN isnan(centrality) THEN NULL ELSE centrality END AS centrality,
               CASE WHEN isnan(focus_score) THEN NULL ELSE focus_score END AS focus_score FROM repomap_entries)
  GROUP BY ALL
), best AS (
  SELECT query_id, generation_id, path, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s4 FROM search_hits GROUP BY ALL
), cand AS (
  SELECT own.*, s4 FROM own LEFT JOIN best USING (query_id, generation_id, path)
), ranks AS (
  SELECT *, count(*) OVER w AS n,
         count(*) OVER (PARTITION BY query_id ORDER BY coalesce(s1, '-infinity'::DOUBLE) DESC RANGE UNBOUNDED PRECEDING) AS c1,
         count(*) OVER (PARTITION BY query_id ORDER BY coalesce(s2, '-infinity'::DOUBLE) DESC RANGE UNBOUNDED PRECEDING) AS c2,
         count(*) OVER (PARTITION BY query_id ORDER BY coalesce(s3, '-infinity'::DOUBLE) DESC RANGE UNBOUNDED PRECEDING) AS c3,
         count(*) OVER (PARTITION BY query_id ORDER BY coalesce(s4, '-infinity'::DOUBLE) DESC RANGE UNBOUNDED PRECEDING) AS c4
  FROM cand WINDOW w AS (PARTITION BY query_id)
), sorted AS (
  SELECT *, list_sort([c1 / n, c2 / n, c3 / n, c4 / n]) AS r, round((c1 / n + c2 / n + c3 / n + c4 / n) / 4, 12) AS mean_rank FROM ranks
), tails AS (
  SELECT *, least(1.0, 4 * least(
    4 * r[1] * pow(1 - r[1], 3) + 6 * pow(r[1], 2) * pow(1 - r[1], 2) + 4 * pow(r[1], 3) * (1 - r[1]) + pow(r[1], 4),
    6 * pow(r[2], 2) * pow(1 - r[2], 2) + 4 * pow(r[2], 3) * (1 - r[2]) + pow(r[2], 4),
    4 * pow(r[3], 3) * (1 - r[3]) + pow(r[3], 4), pow(r[4], 4))) AS p FROM sorted
)
"""

ORACLE = {
    "p2_found": _RANKED
    + """
SELECT query_id, generation_id, path
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12), mean_rank, generation_id, path) AS place FROM tails)
JOIN (SELECT query_id, max(top_k) AS top_k FROM ranking_queries GROUP BY query_id) USING (query_id)
WHERE place <= top_k
""",
}
