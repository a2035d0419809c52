"""Queries of ranking, vectors, fusion, packing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import ANSWER_STOPWORDS, SUPPORT_STOPWORDS, fold_accents
from quarrylight.operators import evaluation, fusion, lexical, packing, vectors
from quarrylight.plans import lifecycle
from quarrylight.runtime import cut, table

QUESTIONS = [(1, "archivo de la biblioteca con notas"), (2, "the handbook of the students"), (3, "grafo de relaciones sin revisar")]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "title", "text")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_cases").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.coalesce("route_mode", F.lit("factual_local")).alias("route"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_statistics(_docs(spark, sf_dir))


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_statistics(_docs(spark, sf_dir)).select("documents", F.round("mean_length", 6).alias("mean_length"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf_dir), _asked(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25(_docs(spark, sf_dir), _asked(spark)).withColumn("score", F.round("score", 6))
    return lexical.top(scored, 10, "query_id", [F.desc("score"), F.col("doc_id")])


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.sparse_vectors(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.sparse_search(_docs(spark, sf_dir), _asked(spark)).withColumn("score", F.round("score", 6))
    return lexical.top(scored, 10, "query_id", [F.desc("score"), F.col("doc_id")])


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, rows.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def cosine_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.search(rows, rows.where("vec_id % 100 = 0"), 10)
    return found.join(rows.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(e), 5).alias("norm"), F.round(vectors.cosine(e, vectors.normalised(e, 32)), 5).alias("half"))


def quantized_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search_quantized(vectors.quantized(rows), rows.where("vec_id % 100 = 0"), 10, exact=rows)


def quantized_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten nearest that are among the ten that ``quantized_topk`` serves."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    exact = vectors.search(rows, asked, 10).select("query_id", "vec_id")
    coded = quantized_topk(spark, sf_dir).select("query_id", "vec_id", F.lit(1.0).alias("found"))
    return exact.join(coded, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("found", F.lit(0.0))), 4).alias("recall"))


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hash_embedding(_docs(spark, sf_dir)).select("doc_id", "index", F.round("value", 6).alias("value"))


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bm25_topk(spark, sf_dir), sparse_search(spark, sf_dir)


def _over_cases(name: str):
    """The search ``name`` with every question of golden_cases instead of the three literal ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        asked = _questions(spark, sf_dir).where("query_id IS NOT NULL AND query IS NOT NULL").select("query_id", "query")
        keys, order = ["query_id", "doc_id"], [F.desc("score"), F.col("doc_id")]
        scored = lexical.bm25(docs, asked).select(*keys, F.round("score", 6).alias("score"))
        if name == "bm25_scores":
            return scored
        best = lexical.top(scored, 10, "query_id", order)
        if name == "bm25_topk":
            return best
        if name == "facet_fusion":
            hits = best.join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("path")), "doc_id")
            return fusion.focus_fusion(hits.select((F.col("query_id") - 1).alias("facet"), "path", "rank", "score")).select("path", F.round("fused", 9).alias("fused"), "appearances", "best")
        dots = lexical.sparse_search(docs, asked).withColumn("score", F.round("score", 6))
        sparse = lexical.top(dots, 10, "query_id", order)
        if name == "sparse_search":
            return sparse
        if name == "rank_fusion":
            return fusion.reciprocal_ranks([best, sparse], keys).select(*keys, F.round("score", 9).alias("score"), "first_list", "first_rank")
        return fusion.dense_sparse(best, sparse, keys).select(*keys, "dense_rank", "sparse_rank", "visits", F.round("score", 9).alias("score"))

    run.__name__ = f"{name}_of_cases"
    return run


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_ranks(list(_two_rankings(spark, sf_dir)), ["query_id", "doc_id"])
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "first_list", "first_rank")


def dense_sparse_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_rankings(spark, sf_dir)
    return fusion.dense_sparse(a, b, ["query_id", "doc_id"]).select("query_id", "doc_id", "dense_rank", "sparse_rank", "visits", F.round("score", 9).alias("score"))


def facet_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("path")), "doc_id")
    facets = hits.select((F.col("query_id") - 1).alias("facet"), "path", "rank", "score")
    return fusion.focus_fusion(facets).select("path", F.round("fused", 9).alias("fused"), "appearances", "best")


def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.evidence(_docs(spark, sf_dir), _questions(spark, sf_dir))


def pack_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(lifecycle.retrieve(_docs(spark, sf_dir), _questions(spark, sf_dir)))
    return packing.pack_summary(packing.pack(items), items)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lifecycle.retrieve(_docs(spark, sf_dir), _questions(spark, sf_dir))
    hits = items.select("query_id", "rank", "document_id", fold_accents(F.concat_ws(" ", "title", "snippet")).alias("blob"))
    words = table(spark, sf_dir, "golden_cases").select(F.col("item_id").alias("query_id"), F.posexplode("expected_keywords").alias("position", "keyword"))
    return evaluation.retrieval_metrics(hits, words.withColumn("keyword", fold_accents(F.col("keyword"))))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = cut(lifecycle.retrieve(_docs(spark, sf_dir), _questions(spark, sf_dir), k=5))
    answers = table(spark, sf_dir, "golden_cases").select(F.col("item_id").alias("query_id"), F.concat("expected_answer", F.lit(" [1, 2]")).alias("answer"))
    return answers, items.select("query_id", "rank", F.concat_ws(" ", "title", "snippet").alias("text"), "citable")


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.claim_support(*_answers(spark, sf_dir))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grounding(*_answers(spark, sf_dir))


def _best_texts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, rank, doc_id and the whole title and text of the ``k`` best documents of each question."""
    docs = _docs(spark, sf_dir)
    asked = _questions(spark, sf_dir).where("query_id IS NOT NULL AND query IS NOT NULL").select("query_id", "query")
    scored = lexical.bm25(docs, asked).withColumn("score", F.round("score", 6))
    best = lexical.top(scored, k, "query_id", [F.desc("score"), F.col("doc_id")])
    return best.join(docs, "doc_id").select("query_id", "rank", F.col("doc_id").alias("document_id"), F.concat_ws(" ", "title", "text").alias("text"))


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics over whole texts instead of snippets."""
    hits = _best_texts(spark, sf_dir, 20).select("query_id", "rank", "document_id", fold_accents(F.col("text")).alias("blob"))
    words = table(spark, sf_dir, "golden_cases").where("item_id IS NOT NULL").select(F.col("item_id").alias("query_id"), F.posexplode("expected_keywords").alias("position", "keyword"))
    return evaluation.retrieval_metrics(hits, words.withColumn("keyword", fold_accents(F.col("keyword"))))


def _text_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers = table(spark, sf_dir, "golden_cases").where("item_id IS NOT NULL").select(F.col("item_id").alias("query_id"), F.concat("expected_answer", F.lit(" [1, 2]")).alias("answer"))
    return answers, _best_texts(spark, sf_dir, 5).withColumn("citable", F.lit(True))


def text_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.claim_support(*_text_answers(spark, sf_dir))


def text_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grounding(*_text_answers(spark, sf_dir))


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the expected answers, held against the texts that are found for their questions."""
    cases = table(spark, sf_dir, "golden_cases").where("item_id IS NOT NULL")
    answers = cases.select(F.col("item_id").alias("query_id"), F.concat("expected_answer", F.lit(" [1, 2]")).alias("answer"), F.col("question").alias("expected"), F.lit(2).alias("citations"), "min_citations", F.slice(F.coalesce("expected_keywords", F.array().cast("array<string>")), 1, 2).alias("forbidden"))
    return evaluation.answer_scores(answers, _best_texts(spark, sf_dir, 5))


def _path_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths ranked by their best hit, and those with the best centrality, which a run should find."""
    once = table(spark, sf_dir, "search_hits").where("NOT isnan(score)").groupBy("query_id", "path").agg(F.max("score").alias("score"))
    hits = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "path")))
    wanted = table(spark, sf_dir, "repomap_entries").where("NOT isnan(centrality)").groupBy("query_id", "path").agg(F.max("centrality").alias("c"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("c"), "path"))
    return hits.select("query_id", "path", "rank"), wanted.withColumn("n", place).where("n <= 3").select("query_id", "path")


def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.ranked_paths(*_path_hits(spark, sf_dir))
    return found.select("query_id", "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("recall", 6).alias("recall"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(*_path_hits(spark, sf_dir))


def answer_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "golden_cases").select(F.col("item_id").alias("query_id"), F.col("question").alias("answer"), F.col("expected_answer").alias("expected"))
    return evaluation.answer_metrics(cases)


def case_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "golden_cases").select(F.coalesce("category", F.lit("general")).alias("category"), "min_citations", "min_distinct_documents")
    return evaluation.macro_means(cases, "category", ["min_citations", "min_distinct_documents"], F.col("min_citations") >= 1)


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    half = lambda p: events.where(p).groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("value"))
    return evaluation.metric_deltas(half("user_id % 2 = 0"), half("user_id % 2 = 1"), ["event_type", "day"])


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "generations").select("repository_id", "generation_id", "schema_version")
    return evaluation.previous_run(runs, ["repository_id"], "generation_id", "generation_id")


QUERIES = {
    f.__name__: f
    for f in (
        term_statistics, corpus_statistics, bm25_scores, bm25_topk, sparse_vectors, sparse_search, cosine_topk, cosine_by_label, vector_norms, quantized_topk, quantized_recall, hash_embeddings, rank_fusion, dense_sparse_fusion,
        facet_fusion, evidence_packs, pack_summaries, retrieval_metrics, claim_support, grounding, text_metrics, text_support, text_grounding, text_scores, path_metrics, run_summary, answer_relevance, case_means, metric_deltas, run_history,
    )
}

_TOK = "list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}_\\-]+'), lambda w: length(w) > 2), lambda w: translate(lower(w), 'áéíóúü', 'aeiouu'))"
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
_POSTINGS = f"""
WITH docs AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents),
postings AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM docs),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM postings GROUP BY ALL)
"""
_BM25 = (
    _POSTINGS
    + f""", asked(query_id, query) AS (VALUES {_ASKED}),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("query")}) AS term FROM asked) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(length, 1) / greatest(mean, 1e-9)))), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY query_id, doc_id),
bm25_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10)
"""
)
_SPARSE = f""", most AS (SELECT doc_id, max(tf) AS m FROM tf GROUP BY doc_id),
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_TOK.format("query")}) AS term FROM asked) GROUP BY ALL),
qmost AS (SELECT query_id, max(tf) AS m FROM qtf GROUP BY query_id),
sparse_scored AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(sum((1 + q.tf / qmost.m) * (1 + t.tf / most.m)), 6) AS score
  FROM qtf q JOIN qmost USING (query_id) JOIN tf t ON t.term = q.term JOIN most USING (doc_id) GROUP BY ALL),
sparse_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sparse_scored) WHERE rank <= 10)
"""
_COSINE = """
WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
"""

ORACLE = {
    "term_statistics": _POSTINGS + "SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY term",
    "corpus_statistics": _POSTINGS + "SELECT count(*) AS documents, round(avg(len(w)), 6) AS mean_length FROM docs",
    "bm25_scores": _BM25 + "SELECT query_id, doc_id, score FROM scored",
    "bm25_topk": _BM25 + "SELECT query_id, doc_id, score, rank FROM bm25_top",
    "sparse_vectors": _POSTINGS + "SELECT doc_id, count(*) AS terms, round(sum(1 + tf / m), 6) AS total FROM tf JOIN (SELECT doc_id, max(tf) AS m FROM tf GROUP BY doc_id) USING (doc_id) GROUP BY doc_id",
    "sparse_search": _BM25 + _SPARSE + "SELECT query_id, doc_id, score, rank FROM sparse_top",
    "cosine_topk": _COSINE + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
    "cosine_by_label": _COSINE + "SELECT query_id, label, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY ALL",
    "rank_fusion": _BM25
    + _SPARSE
    + """, both_lists AS (SELECT query_id, doc_id, rank, 0 AS list FROM bm25_top UNION ALL SELECT query_id, doc_id, rank, 1 FROM sparse_top)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(min(list) AS INTEGER) AS first_list, CAST(arg_min(rank, list) AS INTEGER) AS first_rank FROM both_lists GROUP BY ALL""",
    "dense_sparse_fusion": _BM25
    + _SPARSE
    + """SELECT query_id, doc_id, a.rank AS dense_rank, b.rank AS sparse_rank, CAST((a.rank IS NOT NULL)::INT + (b.rank IS NOT NULL)::INT AS INTEGER) AS visits,
  round(((a.rank IS NOT NULL)::INT + (b.rank IS NOT NULL)::INT) * (coalesce(0.65 / (60 + a.rank), 0) + coalesce(0.35 / (60 + b.rank), 0)), 9) AS score
FROM bm25_top a FULL JOIN sparse_top b USING (query_id, doc_id)""",
    "hash_embeddings": """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(coalesce(text, ''))), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS word FROM documents),
h AS (SELECT doc_id, sha256(word) AS d FROM w),
p AS (SELECT doc_id, CAST(CAST('0x' || substr(d, 1, 2) AS INTEGER) % 64 AS INTEGER) AS index, sum(CASE WHEN CAST('0x' || substr(d, 3, 2) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM h GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(s * s)) AS size FROM p GROUP BY doc_id)
SELECT doc_id, index, round(s / size, 6) AS value FROM p JOIN z USING (doc_id) WHERE size > 0""",
    "case_means": """SELECT coalesce(category, 'general') AS category, round(avg(min_citations), 6) AS min_citations, round(avg(min_distinct_documents), 6) AS min_distinct_documents,
  round(avg(CASE WHEN min_citations >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS cases FROM golden_cases GROUP BY 1""",
    "metric_deltas": """
WITH a AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY ALL), b AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY ALL)
SELECT event_type, day, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) AS delta FROM a FULL JOIN b USING (event_type, day)""",
    "run_history": "SELECT repository_id, generation_id, schema_version, lag(generation_id) OVER (PARTITION BY repository_id ORDER BY generation_id) AS previous FROM generations",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[1:32] AS DOUBLE[])), 5) AS half FROM embeddings",
    "facet_fusion": _BM25
    + """, h AS (SELECT query_id - 1 AS facet, coalesce(source, '') AS path, min(rank) AS rank, max(score) AS score FROM bm25_top JOIN documents USING (doc_id) GROUP BY ALL)
SELECT path, round(sum((CASE WHEN facet = 0 AND (SELECT count(DISTINCT facet) FROM h) > 1 THEN 0.85 ELSE 1.0 END) / (10 + rank)), 9) AS fused, count(*) AS appearances, max(score) AS best FROM h GROUP BY path""",
    "answer_relevance": """
WITH t AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(strip_accents(lower(coalesce(question, ''))), '[\\p{L}\\p{N}_\\-]+')) AS a, list_distinct(regexp_extract_all(strip_accents(lower(coalesce(expected_answer, ''))), '[\\p{L}\\p{N}_\\-]+')) AS e FROM golden_cases),
f AS (SELECT query_id, list_filter(a, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains(%s, w)) AS a, list_filter(e, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains(%s, w)) AS e FROM t)
SELECT query_id, round(len(list_intersect(e, a)) / greatest(len(e), 1), 3) AS relevance FROM f"""
    % (list(ANSWER_STOPWORDS), list(ANSWER_STOPWORDS)),
}

#: Searches that are also run for all questions of golden_cases; their SQL differs in ``asked`` only.
_OVER_CASES = ("bm25_scores", "bm25_topk", "sparse_search", "rank_fusion", "dense_sparse_fusion", "facet_fusion")
QUERIES |= {f"{name}_of_cases": _over_cases(name) for name in _OVER_CASES}
ORACLE |= {
    f"{name}_of_cases": ORACLE[name].replace(f"asked(query_id, query) AS (VALUES {_ASKED})", "asked AS (SELECT item_id AS query_id, question AS query FROM golden_cases WHERE item_id IS NOT NULL AND question IS NOT NULL)")
    for name in _OVER_CASES
}

_CASES = ORACLE["bm25_topk_of_cases"].removesuffix("SELECT query_id, doc_id, score, rank FROM bm25_top")
_BEST = _CASES.replace("WHERE rank <= 10)", "WHERE rank <= 20)") + ", best AS (SELECT query_id, rank, b.doc_id, concat_ws(' ', title, text) AS text FROM bm25_top b JOIN documents d ON d.doc_id = b.doc_id)"
_WEIGHTY = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({{0}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_\\-]+')), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^\\p{{{{Nd}}}}+$') AND NOT list_contains({list(SUPPORT_STOPWORDS)}, w))"
_SUPPORT = (
    _BEST
    + r""", evidence AS (SELECT query_id, rank, text FROM best WHERE rank <= 5), said AS (SELECT item_id AS query_id, expected_answer || ' [1, 2]' AS answer FROM golden_cases WHERE item_id IS NOT NULL),
l AS (SELECT query_id, list_transform(string_split(coalesce(answer, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\r$', ''), '^\s*(?:#{1,6}|[*+\-]|\p{Nd}+[.)])\s+', ''))) AS l FROM said),
c AS (SELECT query_id, list_filter(list_transform(flatten(list_transform(l, lambda x: string_split(regexp_replace(x, '([.!?])\s+([\p{Lu}\p{Nd}¡¿])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> '') AS c FROM l),
claims AS (SELECT query_id, CAST(i - 1 AS INTEGER) AS n, c[i] AS claim FROM (SELECT query_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)),
weighed AS (SELECT query_id, n, """.replace("\\", "\\")
    + _WEIGHTY.format("regexp_replace(claim, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', ' ', 'g')")
    + """ AS tokens, contains(claim, '[1, 2]') AS cites FROM claims),
held AS (SELECT query_id, rank AS ref, """
    + _WEIGHTY.format("text")
    + """ AS known FROM evidence WHERE rank <= 2),
pairs AS (SELECT w.query_id, w.n, len(tokens) AS t, r.ref, len(h.known) AS k, len(list_intersect(tokens, h.known)) AS shared, h.known IS NOT NULL AS ok FROM (SELECT * FROM weighed WHERE len(tokens) >= 3) w LEFT JOIN (SELECT unnest([1, 2]) AS ref) r ON w.cites LEFT JOIN held h ON h.query_id = w.query_id AND h.ref = r.ref),
rated AS (SELECT *, shared / greatest(t, 1) AS recall, shared / greatest(k, 1) AS precision FROM pairs),
support AS (SELECT query_id, n, max(CASE WHEN ok THEN round(0.75 * recall + 0.25 * CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 3) ELSE 0.0 END) AS support, count(*) FILTER (WHERE ok) AS citable, count(ref) AS referenced FROM rated GROUP BY ALL)
"""
)
ORACLE |= {
    "text_metrics": _BEST
    + """, hits AS (SELECT query_id, rank, doc_id, strip_accents(lower(text)) AS blob FROM best),
kw AS (SELECT item_id AS query_id, i - 1 AS position, strip_accents(lower(expected_keywords[i])) AS keyword FROM (SELECT item_id, expected_keywords, unnest(range(1, len(expected_keywords) + 1)) AS i FROM golden_cases WHERE item_id IS NOT NULL)),
f AS (SELECT kw.query_id, position, keyword, min(rank) FILTER (WHERE contains(blob, keyword)) AS place FROM kw LEFT JOIN hits ON hits.query_id = kw.query_id GROUP BY ALL),
p AS (SELECT query_id, avg((place IS NOT NULL)::INT) AS recall, arg_min(place, position) FILTER (WHERE place IS NOT NULL) AS first, sum(coalesce(1 / log2(place + 1), 0)) AS gain, count(*) AS n FROM f GROUP BY 1),
d AS (SELECT query_id, count(DISTINCT doc_id) AS documents FROM hits GROUP BY 1)
SELECT query_id, round(recall, 6) AS recall_at_k, round(coalesce(1 / first, 0), 6) AS mrr, round(least(1.0, gain / list_sum(list_transform(range(2, n + 2), lambda i: 1 / log2(i)))), 6) AS ndcg, coalesce(documents, 0) AS documents FROM p LEFT JOIN d USING (query_id)""",
    "text_support": _SUPPORT + "SELECT * FROM support",
    "text_grounding": _SUPPORT
    + """, per AS (SELECT query_id, count(*) AS claims, avg((citable > 0)::INT) AS cited, avg((citable > 0 AND support >= 0.18)::INT) AS supported, avg(support) AS mean FROM support GROUP BY 1),
w AS (SELECT query_id, list_filter(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}_\\-]+'), lambda w: length(w) > 2) AS w FROM said), e AS (SELECT query_id, lower(string_agg(text, ' ')) AS t FROM evidence GROUP BY 1),
cov AS (SELECT query_id, len(list_filter(w, lambda x: contains(coalesce(t, ''), x))) / greatest(len(w), 1) AS coverage FROM w LEFT JOIN e USING (query_id)),
r AS (SELECT query_id, coalesce(claims, 0) AS claims, coalesce(cited, 0) AS cited, coalesce(supported, 0) AS supported, least(1.0, 0.20 * coverage + 0.35 * round(coalesce(cited, 0), 3) + 0.25 * round(coalesce(supported, 0), 3) + 0.20 * round(coalesce(mean, 0), 3)) AS score FROM cov LEFT JOIN per USING (query_id)),
k AS (SELECT *, claims > 0 AND (cited < 1 OR supported < cited) AS weak FROM r)
SELECT query_id, claims, round(CASE WHEN weak THEN least(score, 0.74) ELSE score END, 3) AS grounding, CASE WHEN cited = 0 OR score < 0.35 THEN 'unverified' WHEN weak OR score < 0.7 THEN 'partially_verified' ELSE 'verified' END AS verdict FROM k""",
}

_SCORED = f"list_filter(list_distinct(regexp_extract_all(strip_accents(lower(coalesce({{0}}, ''))), '[\\p{{{{L}}}}\\p{{{{N}}}}_\\-]+')), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^\\p{{{{Nd}}}}+$') AND NOT list_contains({list(ANSWER_STOPWORDS)}, w))"
_PATHS = """
WITH o AS (SELECT query_id, path, max(score) AS score FROM search_hits WHERE NOT isnan(score) GROUP BY 1, 2), h AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, path) AS rank FROM o),
w AS (SELECT query_id, path, max(centrality) AS c FROM repomap_entries WHERE NOT isnan(centrality) GROUP BY 1, 2), e AS (SELECT query_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST, path) AS n FROM w) WHERE n <= 3),
per AS (SELECT e.query_id, CAST(max((rank IS NOT NULL)::INT) AS INTEGER) AS hit, coalesce(1 / min(rank), 0) AS reciprocal_rank, avg((rank IS NOT NULL)::INT) AS recall FROM e LEFT JOIN h ON h.query_id = e.query_id AND h.path = e.path AND rank <= 20 GROUP BY 1)
"""
ORACLE |= {
    "path_metrics": _PATHS + "SELECT query_id, hit, round(reciprocal_rank, 6) AS reciprocal_rank, round(recall, 6) AS recall FROM per",
    "run_summary": _PATHS
    + """SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(1 - hit) AS BIGINT) AS failures, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(recall), 6) AS mean_recall,
  CAST(count(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM h)) AS BIGINT) AS without_result FROM per""",
    "text_scores": _SUPPORT
    + ", said2 AS (SELECT query_id, n, "
    + _SCORED.format("regexp_replace(claim, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', ' ', 'g')")
    + " AS tokens, contains(claim, '[1, 2]') AS cites FROM claims), ev AS (SELECT query_id, "
    + _SCORED.format("text")
    + """ AS known FROM evidence),
b AS (SELECT s.query_id, n, cites, max(coalesce(len(list_intersect(tokens, known)) / len(tokens), 0)) AS support FROM (SELECT * FROM said2 WHERE len(tokens) >= 3) s LEFT JOIN ev USING (query_id) GROUP BY ALL),
pc AS (SELECT query_id, count(*) AS claims, count(*) FILTER (WHERE support >= 0.18) AS held, count(*) FILTER (WHERE cites) AS marked, CASE WHEN bool_or(cites) THEN 2 ELSE 0 END AS referenced FROM b GROUP BY 1),
g AS (SELECT item_id AS query_id, strip_accents(lower(coalesce(expected_answer || ' [1, 2]', ''))) AS a, """
    + _SCORED.format("expected_answer || ' [1, 2]'")
    + " AS atk, "
    + _SCORED.format("question")
    + """ AS etk, min_citations, list_filter(coalesce(expected_keywords, [])[1:2], lambda x: trim(x) <> '') AS f FROM golden_cases WHERE item_id IS NOT NULL),
m AS (SELECT query_id, len(list_intersect(etk, atk)) / greatest(len(etk), 1) AS relevance, coalesce(held / claims, 0) AS support, CASE WHEN 2 < greatest(0, coalesce(min_citations, 0)) THEN 0 ELSE coalesce(marked / claims * least(1.0, 2 / greatest(referenced, 1)), 0) END AS citation,
  CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: contains(a, lower(x)))) / len(f) ELSE 0 END AS broken FROM g LEFT JOIN pc USING (query_id))
SELECT query_id, round(relevance, 3) AS relevance, round(support, 3) AS support_coverage, round(citation, 3) AS citation_coverage, round(broken, 3) AS forbidden_rate, floor(greatest(0, least(1, 0.45 * support + 0.30 * citation + 0.25 * relevance - 0.35 * broken)) * 1000 + 0.5 + 1e-9) / 1000 AS grounding,
  floor(greatest(0, least(1, 0.35 * relevance + 0.35 * support + 0.20 * citation + 0.10 * (1 - broken))) * 1000 + 0.5 + 1e-9) / 1000 AS overall FROM m""",
}
