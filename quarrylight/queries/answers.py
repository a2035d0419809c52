"""Queries around answers: variants, context, excerpts, citations, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import answers, catalog, extract, graph
from quarrylight.plans import lifecycle
from quarrylight.runtime import table


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "golden_cases")
    return answers.query_variants(cases.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.lit("multi_hop").alias("route")))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_cases").select("item_id", answers.needs_context(F.col("question")).alias("follow_up"))


def conversation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The talk before each user's last event, its fields read as messages."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chat_id"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("event_type").alias("content")
    )
    return answers.conversation_context(rows)


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.excerpts(table(spark, sf_dir, "documents"), "archivo de la biblioteca", 200)


def title_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("title IS NOT NULL AND text IS NOT NULL")
    return docs.select("doc_id", answers.source_span(F.col("text"), F.col("title")).alias("s")).select("doc_id", "s.start", "s.end")


def citation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "golden_cases").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.lit("factual_local").alias("route"), F.concat("expected_answer", F.lit(" [1, 3] [9]")).alias("answer"))
    docs = table(spark, sf_dir, "documents")
    items = lifecycle.retrieve(docs, cases.drop("answer"), k=5)
    sources = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("source"))
    evidence = items.join(sources, "document_id").select("query_id", "rank", "citable", "source", "snippet").dropDuplicates(["query_id", "rank", "source"])
    return answers.bind_citations(cases, evidence).select("query_id", "rank", "state")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.lit("Grounding score: 0."), F.col("status"), F.element_at(F.array(F.lit("verified"), F.lit("unverified"), F.lit("conflicting"), F.lit("partially verified")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("t"))
    return texts.select("doc_id", answers.parse_verdict(F.col("t")).alias("v")).select("doc_id", "v.verdict", "v.score")


def substantive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").select("query_id", "path", F.coalesce(F.col("kind") != "file", F.lit(False)).alias("substantive"))
    return answers.without_thin_chunks(hits).groupBy("query_id").agg(F.count("*").alias("n"))


def inferred_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that name no single symbol, as possible callers of every symbol they may name."""
    active = catalog.active_generations(table(spark, sf_dir, "generations"))
    files = table(spark, sf_dir, "files").join(active.select("generation_id"), "generation_id", "left_semi")
    symbols = extract.symbols(files)
    calls = graph.resolve_names(extract.edges(files).where("relation = 'calls'"), symbols).withColumn("unresolved", F.col("resolved_id").isNull())
    return answers.inferred_edges(calls, symbols).select("generation_id", "source_path", "line", "target_name", "symbol_id", "inferred_confidence").distinct()


QUERIES = {
    f.__name__: f for f in (query_variants, follow_ups, conversation_contexts, excerpts, title_spans, citation_states, verdicts, substantive_hits, inferred_callers)
}

_CUES = [*answers.POINTERS, *answers.MENTIONS, *answers.CONTINUERS, *(f"{a} {b}" for a in answers.ASKED_ABOUT[0] for b in answers.ASKED_ABOUT[1])]

ORACLE = {
    "follow_ups": f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(question, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM golden_cases)
SELECT item_id, coalesce(w[1] IN ({", ".join(f"'{x}'" for x in answers.OPENERS)}), false) OR len(list_filter([{", ".join(f"'{x}'" for x in _CUES)}], lambda c: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || c || ' '))) > 0 AS follow_up FROM w""",
    "verdicts": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'conflicting' ELSE 'partially_verified' END AS verdict, 0.0::DOUBLE AS score FROM documents",
    "title_spans": """
WITH e AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS w FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, length(s) > 0 AND length(w) > 0 AS ok, instr(s, w) AS a, length(w) AS n, instr(s, substr(w, 1, 80)) AS b, length(substr(w, 1, 80)) AS m FROM e)
SELECT doc_id, CAST(CASE WHEN ok AND a > 0 THEN a - 1 WHEN ok AND b > 0 THEN b - 1 END AS INTEGER) AS start, CAST(CASE WHEN ok AND a > 0 THEN a - 1 + n WHEN ok AND b > 0 THEN b - 1 + m END AS INTEGER) AS "end" FROM p""",
    "substantive_hits": """SELECT query_id, count(*) AS n FROM (SELECT query_id, coalesce(kind <> 'file', false) AS s, max(coalesce(kind <> 'file', false)::INT) OVER (PARTITION BY query_id) AS m FROM search_hits) WHERE m = 0 OR s GROUP BY query_id""",
    "conversation_contexts": """
WITH r AS (SELECT user_id AS chat_id, event_id AS position, CASE WHEN event_id % 2 = 0 THEN 'Usuario: ' ELSE 'Asistente: ' END AS who, event_type AS content FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY position DESC) AS back FROM r)
SELECT chat_id, string_agg(who || content, chr(10) ORDER BY position) AS context, CAST(count(*) AS INTEGER) AS messages FROM l WHERE back <= 4 GROUP BY chat_id""",
}
