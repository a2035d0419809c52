"""Queries of lookups and relations over the tables; symbols and edges are read off the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import answers, catalog, enrich, fusion, graph, lexical, relate
from quarrylight.queries.text import _PROPS
from quarrylight.runtime import table
from quarrylight.sources import admission


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a symbol, as symbols named by their headings."""
    rows = table(spark, sf_dir, "chunks").where("symbol_id IS NOT NULL AND heading IS NOT NULL")
    return rows.groupBy("generation_id", F.col("symbol_id").alias("id")).agg(
        F.min(F.struct("heading", "kind", "path", "line_start", "line_end")).alias("r")
    ).select("generation_id", "id", F.col("r.heading").alias("name"), F.concat_ws(".", "r.kind", "r.heading").alias("qualified_name"), F.col("r.path").alias("path"), F.col("r.line_start").alias("line_start"), F.col("r.line_end").alias("line_end"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call in each chunk, as an edge to a name."""
    rows = table(spark, sf_dir, "chunks").select("generation_id", "id", F.regexp_extract("content", r"([A-Za-z_][A-Za-z0-9_]*)\(", 1).alias("target_name"), "heading", "symbol_id").distinct()
    named = rows.select("generation_id", F.col("id").alias("source_id"), F.when(F.col("target_name") != "", F.col("target_name")).otherwise(F.col("heading")).alias("target_name"), F.col("symbol_id").alias("target_symbol_id"))
    return named.where("target_name IS NOT NULL").withColumn("confidence", F.lit(0.72)).distinct()


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ranking_queries").select("query_id", F.split_part("focus_text", F.lit(" "), F.lit(1)).alias("query")).where("query <> ''").distinct()


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_cases").where("item_id IS NOT NULL")


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = graph.resolve_names(_calls(spark, sf_dir), _symbols(spark, sf_dir))
    return named.select("generation_id", "source_id", "target_name", "target_symbol_id", "resolved_id", "resolved_confidence")


def possible_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = graph.resolve_names(_calls(spark, sf_dir), _symbols(spark, sf_dir)).withColumn("unresolved", F.col("resolved_id").isNull())
    found = answers.inferred_edges(calls, _symbols(spark, sf_dir))
    return found.select("generation_id", "source_id", "symbol_id", "inferred_confidence").distinct()


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unresolved(_calls(spark, sf_dir), _symbols(spark, sf_dir)).select("generation_id", "source_id", "target_name")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest chunk around the first line of each hit."""
    points = table(spark, sf_dir, "search_hits").select("generation_id", "path", F.col("query_id").alias("id"), F.col("line_start").alias("line")).distinct()
    spans = table(spark, sf_dir, "chunks").select("generation_id", "path", F.col("id").alias("name"), "line_start", "line_end").distinct()
    return graph.containing_symbol(points, spans, ["generation_id", "path"])


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.symbol_search(_symbols(spark, sf_dir), _words(spark, sf_dir))


def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _symbols(spark, sf_dir).select(F.xxhash64("name").alias("query_id"), F.col("name").alias("query")).unionByName(_words(spark, sf_dir)).select("query").distinct()
    return relate.resolve_symbols(_symbols(spark, sf_dir), asked.withColumn("query_id", F.col("query")))


def layer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("kind") == "symbol", 0).when(F.col("kind") == "chunk", 1).otherwise(2)
    return relate.first_layer(table(spark, sf_dir, "search_hits").select("query_id", "path", "kind", "line_start").distinct(), tier)


def variant_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("query_id IS NOT NULL AND kind IS NOT NULL AND NOT isnan(score)")
    return relate.variant_fusion(hits, "kind", ["generation_id", "path"])


def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "ranking_queries").groupBy("query_id").agg(F.max("focus_text").alias("query"))
    hits = table(spark, sf_dir, "search_hits").where("NOT isnan(score)").groupBy("query_id", "path").agg(F.max("score").alias("score"))
    names = F.regexp_replace("path", r"[^A-Za-z]", " ")
    return hits.join(asked, "query_id").select("query_id", "path", F.round(relate.payload_score(F.col("score"), F.col("query"), names), 9).alias("score"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.propositions(table(spark, sf_dir, "documents"))


def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    props = enrich.propositions(docs)
    texts = props.join(docs.select("doc_id", "title"), "doc_id").select("doc_id", "pos", "sentence", "title")
    return relate.graph_evidence(enrich.document_edges(props), texts, "argumentative").select("doc_id", "pos", "to", "relation", "snippet", "score")


def proposition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve sentences that answer each question best by terms."""
    props = _sentences(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("prop"), F.col("sentence").alias("text"))
    asked = _cases(spark, sf_dir).where("question IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return lexical.bm25_top(props, asked, 12, key="prop")


def summary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over titles, which stand for a document's summary."""
    docs = table(spark, sf_dir, "documents").where("title IS NOT NULL").select("doc_id", F.col("title").alias("text"))
    asked = _cases(spark, sf_dir).where("question IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    scored = lexical.bm25(docs, asked).withColumn("score", F.round("score", 6))
    return lexical.top(scored, 8, "query_id", [F.desc("score"), F.col("doc_id")])


def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("queue"), F.when(F.col("status") == "registered", "PENDING").otherwise("DONE").alias("state"), "created_at")
    return relate.claim_next(jobs, "queue", [F.col("created_at"), F.col("doc_id")])


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of active generations, of a path that some hit names, or of a generation that was abandoned."""
    rows = table(spark, sf_dir, "files").select("generation_id", "path", "repository_id").distinct()
    states = table(spark, sf_dir, "generations")
    named = table(spark, sf_dir, "search_hits").where("reason = 'path'").select("path")
    scopes = [(states.where("state = 'active'"), ["generation_id"]), (named, ["path"]), (states.where("state = 'abandoned'"), ["generation_id"])]
    return relate.scoped_union(rows, ["generation_id", "path", "repository_id"], scopes)


def layers_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What re-reading the failed generations would leave in each layer."""
    gone = table(spark, sf_dir, "generations").where("state IN ('abandoned', 'building')")
    layers = {n: table(spark, sf_dir, n).select("generation_id") for n in ("files", "chunks", "search_hits", "repomap_entries")}
    return relate.clean_layers(gone, layers, "generation_id")


def verified_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("text IS NOT NULL")
    latest = catalog.first_per(files, ["generation_id", "path"], [F.desc("captured_at"), F.desc("content_hash"), F.desc("text")])
    digest = F.regexp_replace(F.lower(F.trim("content_hash")), r"^sha-?256[:=\-]\s*", "")
    held = latest.select("generation_id", "path", digest.alias("digest"), "text")
    chunks = table(spark, sf_dir, "chunks").select("id", "generation_id", "path", "line_start", "line_end").distinct()
    return relate.verified_excerpts(chunks, held)


def code_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    incoming = rows.where("vec_id % 3 = 0").unionByName(rows.where("vec_id % 21 = 0"))
    return relate.code_upsert(rows.where("vec_id % 5 = 0"), incoming, "vec_id")


def compact_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", relate.compact_snippet(F.col("text")).alias("snippet"))


def profile_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", relate.corpus_language(F.lit("es"), F.col("lang")).alias("language"))


def citable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    span = answers.source_span(F.col("text"), F.col("title"))
    ok = relate.citable(F.col("status") == "ready", F.col("doc_id").cast("string"), F.coalesce("mime_type", F.lit("")), span, F.lit(False))
    return docs.select("doc_id", ok.alias("citable"))


def final_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("item_id") % 4 == 0, F.lit(" I could not produce a grounded answer. ")).when(F.col("item_id") % 4 == 1, F.concat(F.lit("The evidence supports: "), "expected_answer")).when(F.col("item_id") % 4 == 2, F.lit("  ")).otherwise(F.col("expected_answer"))
    return _cases(spark, sf_dir).select("item_id", relate.final_text(said, F.when(F.col("item_id") % 2 == 0, "es-ES").otherwise("en")).alias("text"))


def strict_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("expected_answer").alias("answer"), F.col("min_citations").alias("citations"), (F.col("item_id") % 3 == 0).cast("int").alias("unresolved"), (F.col("item_id") % 10 / 10).alias("grounding"))
    return relate.strict_violations(rows, 0.5)


def result_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit(10)
    for route, n in fusion.RESULT_LIMITS.items():
        limit = F.when(F.col("route_mode") == route, n).otherwise(limit)
    return _cases(spark, sf_dir).select("item_id", limit.alias("most"))


def ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each query in their order, with what the table of files holds for them."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "generation_id", "path"))
    ranked = table(spark, sf_dir, "repomap_entries").where("NOT isnan(score) OR score IS NULL").groupBy("query_id", "generation_id", "path").agg(F.max("score").alias("score")).withColumn("rank", place)
    files = catalog.first_per(table(spark, sf_dir, "files").select("generation_id", "path", "language", "size", "captured_at", "content_hash"), ["generation_id", "path"], [F.desc("captured_at"), F.desc("content_hash"), F.desc("size")])
    return ranked.join(files, ["generation_id", "path"]).select("query_id", "rank", "generation_id", "path", "language", "size")


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with the number of its candidates and hits and its best hit."""
    asked = table(spark, sf_dir, "ranking_queries").groupBy("query_id").agg(F.max("asked_at").alias("asked_at"))
    entries = table(spark, sf_dir, "repomap_entries").select("query_id", "generation_id", "path").distinct().groupBy("query_id").agg(F.count("*").alias("candidates"))
    hits = table(spark, sf_dir, "search_hits").distinct().groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max(F.when(~F.isnan("score"), F.col("score"))), 9).alias("best"))
    return asked.join(entries, "query_id", "left").join(hits, "query_id", "left").select("query_id", "asked_at", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("hits", F.lit(0)).alias("hits"), "best")


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node under the heading that it names as its parent."""
    nodes = table(spark, sf_dir, "document_nodes")
    heads = nodes.where("node_type = 'heading'").select("document_id", F.col("id").alias("section_id")).distinct()
    own = nodes.select("document_id", "id", F.col("parent_id").alias("section_id")).distinct()
    return own.join(heads, ["document_id", "section_id"]).select("section_id", "document_id", "id")


def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes under a label of their type and the first three headings above them."""
    path = F.slice("metadata.heading_path", 1, 3)
    label = F.concat(F.col("node_type"), F.lit(":"), F.coalesce(F.when(F.size(path) > 0, F.array_join(path, " > ")), F.col("document_id"), F.lit("")))
    return table(spark, sf_dir, "document_nodes").groupBy(label.alias("label")).agg(F.count_distinct("id").alias("items"), F.min("id").alias("first"))


def compatible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read by a parser whose version ends like that of the latest active generation."""
    states = table(spark, sf_dir, "generations")
    newest = states.where("state = 'active'").agg(F.max(F.struct("generation_id", "parser_version")).alias("r")).select(F.element_at(F.split("r.parser_version", "-"), -1).alias("wanted"))
    fit = states.join(F.broadcast(newest), F.endswith(F.col("parser_version"), F.col("wanted"))).select("generation_id")  # one row
    return table(spark, sf_dir, "files").select("generation_id", "path").distinct().join(fit, "generation_id", "left_semi")


def question_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("item_id", F.posexplode(text.claims(F.concat_ws(" ", "expected_answer", F.lit("A second one! 3 more?\n- and a list item"), "question"))).alias("n", "claim"))


def cued_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences of the corpus would lean on the talk before them, were they asked."""
    return _sentences(spark, sf_dir).select("doc_id", "pos", answers.needs_context(F.col("sentence")).alias("leans"))


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("verified"), F.lit("unverified"), F.lit("conflicting"), F.lit("partially verified")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.lit("Grounding score: 0."), F.col("status"), said).alias("t"))
    return rows.select("doc_id", answers.parse_verdict(F.col("t")).alias("v")).select("doc_id", "v.verdict", "v.score")


def file_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("text IS NOT NULL").select("generation_id", "path", admission.is_binary(F.encode("text", "UTF-8")).alias("binary")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        name_resolution, possible_callers, dangling_edges, line_chunks, symbol_search, symbol_resolution, layer_hits, variant_fusion, payload_scores, graph_evidence, proposition_scores, summary_scores, claimed_jobs, scoped_files, layers_left, verified_excerpts, code_upserts,
        compact_snippets, profile_languages, citable_titles, final_texts, strict_violations, result_limits, ranked_rows, query_history, section_children, evidence_groups, compatible_files, question_claims, cued_questions, document_verdicts, file_binaries,
    )
}

_SYMBOLS = """
symbols AS (SELECT generation_id, id, r.h AS name, concat_ws('.', r.k, r.h) AS qualified_name, r.p AS path, r.a AS line_start, r.b AS line_end FROM (
  SELECT generation_id, symbol_id AS id, min({'h': heading, 'k': kind, 'p': path, 'a': line_start, 'b': line_end}) AS r FROM chunks WHERE symbol_id IS NOT NULL AND heading IS NOT NULL GROUP BY 1, 2))"""
_CALLS = """
calls AS (SELECT DISTINCT generation_id, id AS source_id, CASE WHEN t <> '' THEN t ELSE heading END AS target_name, symbol_id AS target_symbol_id
  FROM (SELECT *, coalesce(regexp_extract(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1), '') AS t FROM chunks) WHERE CASE WHEN t <> '' THEN t ELSE heading END IS NOT NULL)"""
_RESOLVED = f"""WITH {_SYMBOLS}, {_CALLS},
q AS (SELECT generation_id, qualified_name AS k, min(id) AS id FROM symbols GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT generation_id, name AS k, min(id) AS id FROM symbols GROUP BY 1, 2 HAVING count(*) = 1),
resolved AS (SELECT c.*, coalesce(q.id, n.id, l.id) AS resolved_id FROM calls c LEFT JOIN q ON q.generation_id = c.generation_id AND q.k = target_name LEFT JOIN n ON n.generation_id = c.generation_id AND n.k = target_name
  LEFT JOIN n l ON l.generation_id = c.generation_id AND l.k = string_split(target_name, '.')[-1])"""
_WORDS = "words AS (SELECT DISTINCT query_id, split_part(focus_text, ' ', 1) AS query FROM ranking_queries WHERE split_part(focus_text, ' ', 1) <> '')"
_TOK = "list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}_\\-]+'), lambda w: length(w) > 2), lambda w: translate(lower(w), 'áéíóúü', 'aeiouu'))"


def _bm25(source: str, key: str, most: int) -> str:
    return f"""{source},
docs AS (SELECT {key}, {_TOK.format("text")} AS w FROM src), tf AS (SELECT {key}, len(w) AS length, term, count(*) AS tf FROM (SELECT {key}, w, unnest(w) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK.format("question")}) AS term FROM golden_cases WHERE item_id IS NOT NULL AND question IS NOT NULL) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, {key}, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(length, 1) / greatest(mean, 1e-9)))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY query_id, {key})
SELECT * FROM (SELECT query_id, {key}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM scored) WHERE rank <= {most}"""


_VERB = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in relate.VERBS.items()) + " ELSE relation END"
_CUES = [*answers.POINTERS, *answers.MENTIONS, *answers.CONTINUERS, *(f"{a} {b}" for a in answers.ASKED_ABOUT[0] for b in answers.ASKED_ABOUT[1])]

ORACLE = {
    "name_resolution": _RESOLVED + "SELECT generation_id, source_id, target_name, target_symbol_id, resolved_id, CASE WHEN resolved_id IS NULL THEN 0.72 ELSE round(0.72 * 0.95, 6) END::DOUBLE AS resolved_confidence FROM resolved",
    "possible_callers": _RESOLVED
    + """, keys AS (SELECT DISTINCT generation_id, id, unnest([name, qualified_name, string_split(qualified_name, '.')[-1]]) AS k FROM symbols)
SELECT DISTINCT r.generation_id, source_id, k.id AS symbol_id, 0.7::DOUBLE AS inferred_confidence FROM resolved r JOIN keys k ON k.generation_id = r.generation_id AND k.k = r.target_name WHERE resolved_id IS NULL""",
    "dangling_edges": f"WITH {_SYMBOLS}, {_CALLS} SELECT generation_id, source_id, target_name FROM calls c WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = c.target_symbol_id)",
    "line_chunks": """
WITH p AS (SELECT DISTINCT generation_id, path, query_id AS id, line_start AS line FROM search_hits), s AS (SELECT DISTINCT generation_id, path, id AS name, line_start, line_end FROM chunks)
SELECT generation_id, path, id, line, name, line_start, line_end FROM (SELECT p.*, name, line_start, line_end, row_number() OVER (PARTITION BY p.generation_id, p.path, p.id, line ORDER BY line_end - line_start, line_start DESC, name) AS n
  FROM p JOIN s ON s.generation_id = p.generation_id AND s.path = p.path AND line BETWEEN line_start AND line_end) WHERE n = 1""",
    "symbol_search": f"""WITH {_SYMBOLS}, {_WORDS},
m AS (SELECT query_id, generation_id, id, name, qualified_name, path, line_start, CASE WHEN name = query THEN 0 WHEN qualified_name = query THEN 1 WHEN lower(name) = lower(query) THEN 2 ELSE 3 END AS tier
  FROM words JOIN symbols ON contains(lower(name), lower(query)) OR contains(lower(qualified_name), lower(query)))
SELECT query_id, generation_id, id, name, CAST(tier AS INTEGER) AS tier, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(qualified_name), path, line_start, generation_id, id) AS position FROM m) WHERE position <= 20""",
    "symbol_resolution": f"""WITH {_SYMBOLS}, {_WORDS}, asked AS (SELECT DISTINCT query FROM (SELECT name AS query FROM symbols UNION ALL SELECT query FROM words)),
keys AS (SELECT DISTINCT generation_id, id, unnest([id, qualified_name, name]) AS k FROM symbols), one AS (SELECT k, count(DISTINCT (generation_id, id)) AS n, min(id) AS id FROM keys GROUP BY k)
SELECT query AS query_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0) AS candidates FROM asked LEFT JOIN one ON k = query""",
    "layer_hits": """WITH t AS (SELECT DISTINCT query_id, path, kind, line_start, CASE kind WHEN 'symbol' THEN 0 WHEN 'chunk' THEN 1 ELSE 2 END AS tier FROM search_hits)
SELECT query_id, CAST(tier AS INTEGER) AS tier, path, kind, line_start FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM t) WHERE tier = best""",
    "variant_fusion": """WITH o AS (SELECT query_id, kind, generation_id, path, max(score) AS score FROM search_hits WHERE query_id IS NOT NULL AND kind IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC NULLS LAST, generation_id, path) AS rank FROM o)
SELECT query_id, generation_id, path, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(count(*) AS INTEGER) AS variants, string_agg(kind || ':' || rank, ',' ORDER BY kind, rank) AS contributions FROM r GROUP BY ALL""",
    "payload_scores": f"""WITH a AS (SELECT query_id, max(focus_text) AS query FROM ranking_queries GROUP BY 1), h AS (SELECT query_id, path, max(score) AS score FROM search_hits WHERE NOT isnan(score) GROUP BY 1, 2),
t AS (SELECT query_id, path, score, list_distinct({_TOK.format("query")}) AS q, {_TOK.format("regexp_replace(path, '[^A-Za-z]', ' ', 'g')")} AS w FROM h JOIN a USING (query_id))
SELECT query_id, path, round(coalesce(score, 0) + 0.2 * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, w)) / len(q) END, 9) AS score FROM t""",
    "graph_evidence": _PROPS
    + f""", near AS (SELECT doc_id, pos, lead(pos) OVER w AS nxt, lead(kind) OVER w AS next_kind, lead(sentence) OVER w AS other, sentence FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT doc_id, pos, nxt AS "to", CASE next_kind WHEN 'definition' THEN 'defines' WHEN 'causal' THEN 'causes' ELSE 'supports' END AS relation, sentence, other FROM near WHERE nxt IS NOT NULL)
SELECT doc_id, pos, "to", relation, 'Relación: la afirmación ''' || sentence || ''' ' || {_VERB} || ' ''' || other || '''.' AS snippet, 0.8 * 0.8::DOUBLE AS score FROM e WHERE relation IN ('contradicts', 'supports')""",
    "proposition_scores": _bm25(_PROPS + ", src AS (SELECT doc_id || ':' || pos AS prop, sentence AS text FROM props)", "prop", 12),
    "summary_scores": _bm25("WITH src AS (SELECT doc_id, title AS text FROM documents WHERE title IS NOT NULL)", "doc_id", 8),
    "claimed_jobs": """SELECT doc_id, queue, 'RUNNING' AS state, created_at FROM (SELECT doc_id, coalesce(source, '') AS queue, created_at, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY created_at NULLS FIRST, doc_id) AS n FROM documents WHERE status = 'registered') WHERE n = 1""",
    "scoped_files": """SELECT DISTINCT generation_id, path, repository_id FROM files WHERE generation_id IN (SELECT generation_id FROM generations WHERE state IN ('active', 'abandoned')) OR path IN (SELECT path FROM search_hits WHERE reason = 'path')""",
    "layers_left": "WITH g AS (SELECT generation_id FROM generations WHERE state IN ('abandoned', 'building')) "
    + " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS rows, count(*) FILTER (WHERE generation_id IS NULL OR generation_id NOT IN (SELECT generation_id FROM g)) AS \"left\" FROM {n}" for n in ("files", "chunks", "search_hits", "repomap_entries")),
    "verified_excerpts": r"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY generation_id, path ORDER BY captured_at DESC NULLS LAST, content_hash DESC NULLS LAST, text DESC NULLS LAST) AS n FROM files WHERE text IS NOT NULL),
c AS (SELECT DISTINCT id, generation_id, path, line_start, line_end FROM chunks)
SELECT c.id, c.generation_id, c.path, NOT coalesce(sha256(text) = regexp_replace(lower(trim(content_hash)), '^sha-?256[:=-]\s*', ''), false) AS stale,
  CASE WHEN coalesce(sha256(text) = regexp_replace(lower(trim(content_hash)), '^sha-?256[:=-]\s*', ''), false) THEN array_to_string(string_split(text, chr(10))[greatest(1, line_start):greatest(1, line_start, line_end)], chr(10)) ELSE '' END AS excerpt
FROM c LEFT JOIN f ON f.generation_id = c.generation_id AND f.path = c.path AND f.n = 1""",
    "code_upserts": "SELECT vec_id, CASE WHEN vec_id % 21 = 0 THEN 'twice_in_batch' WHEN vec_id % 5 = 0 THEN 'in_store' ELSE 'accepted' END AS outcome FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 3 = 0)",
    "compact_snippets": r"""
WITH e AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(?:^|[;|])\s*(?:title|video\s*id|video\s*url|channel|kind|language)\s*:\s*[^;|]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ .;\-]+|[ .;\-]+$', '', 'g') AS c FROM e)
SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE trim(CASE WHEN contains(substr(c, 1, 220), ' ') THEN regexp_replace(substr(c, 1, 220), ' [^ ]*$', '') ELSE substr(c, 1, 220) END) || '...' END AS snippet FROM b""",
    "profile_languages": "SELECT doc_id, CASE WHEN lower(trim(coalesce(lang, ''))) IN ('', 'auto') THEN 'es' ELSE split_part(lower(trim(lang)), '-', 1) END AS language FROM documents",
    "citable_titles": r"""
WITH e AS (SELECT doc_id, status, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS w, coalesce(mime_type, '') AS kind FROM documents)
SELECT doc_id, coalesce(status = 'ready' AND kind <> 'graph_edge' AND length(s) > 0 AND length(w) > 0 AND (instr(s, w) > 0 OR instr(s, substr(w, 1, 80)) > 0), false) AS citable FROM e""",
    "final_texts": """
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'No pude producir una respuesta fundamentada con la evidencia disponible.' WHEN item_id % 4 = 2 THEN 'No pude producir una respuesta fundamentada con la evidencia disponible.'
  WHEN item_id % 4 = 1 THEN 'The evidence supports: ' || trim(expected_answer) ELSE trim(expected_answer) END AS text FROM golden_cases WHERE item_id IS NOT NULL""",
    "strict_violations": """SELECT item_id AS query_id, CASE WHEN trim(coalesce(expected_answer, '')) = '' THEN 'EMPTY_ANSWER' WHEN min_citations = 0 THEN 'MISSING_CITATIONS' WHEN item_id % 3 = 0 THEN 'UNRESOLVED_CITATION_BINDING' WHEN item_id % 10 < 5 THEN 'LOW_GROUNDING_SCORE' END AS code FROM golden_cases WHERE item_id IS NOT NULL""",
    "result_limits": "SELECT item_id, CAST(CASE route_mode " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fusion.RESULT_LIMITS.items()) + " ELSE 10 END AS INTEGER) AS most FROM golden_cases WHERE item_id IS NOT NULL",
    "ranked_rows": """
WITH o AS (SELECT query_id, generation_id, path, max(score) AS score FROM repomap_entries WHERE NOT isnan(score) OR score IS NULL GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, generation_id, path) AS INTEGER) AS rank FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY generation_id, path ORDER BY captured_at DESC NULLS LAST, content_hash DESC NULLS LAST, size DESC NULLS LAST) AS n FROM files)
SELECT query_id, rank, r.generation_id, r.path, language, size FROM r JOIN f ON f.generation_id = r.generation_id AND f.path = r.path AND n = 1""",
    "query_history": """
WITH a AS (SELECT query_id, max(asked_at) AS asked_at FROM ranking_queries GROUP BY 1), e AS (SELECT query_id, count(*) AS candidates FROM (SELECT DISTINCT query_id, generation_id, path FROM repomap_entries) GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits, round(max(score) FILTER (WHERE NOT isnan(score)), 9) AS best FROM (SELECT DISTINCT * FROM search_hits) GROUP BY 1)
SELECT query_id, asked_at, coalesce(candidates, 0) AS candidates, coalesce(hits, 0) AS hits, best FROM a LEFT JOIN e USING (query_id) LEFT JOIN h USING (query_id)""",
    "section_children": """SELECT s.id AS section_id, n.document_id, n.id FROM (SELECT DISTINCT document_id, id, parent_id FROM document_nodes) n JOIN (SELECT DISTINCT document_id, id FROM document_nodes WHERE node_type = 'heading') s ON s.document_id = n.document_id AND s.id = n.parent_id""",
    "evidence_groups": """SELECT node_type || ':' || coalesce(CASE WHEN len(metadata.heading_path) > 0 THEN array_to_string(metadata.heading_path[1:3], ' > ') END, document_id, '') AS label, count(DISTINCT id) AS items, min(id) AS first FROM document_nodes GROUP BY 1""",
    "compatible_files": """WITH w AS (SELECT string_split(max({'g': generation_id, 'v': parser_version}).v, '-')[-1] AS wanted FROM generations WHERE state = 'active')
SELECT DISTINCT generation_id, path FROM files WHERE generation_id IN (SELECT generation_id FROM generations, w WHERE ends_with(parser_version, wanted))""",
    "question_claims": r"""
WITH t AS (SELECT item_id, concat_ws(' ', expected_answer, 'A second one! 3 more?' || chr(10) || '- and a list item', question) AS t FROM golden_cases WHERE item_id IS NOT NULL),
l AS (SELECT item_id, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\r$', ''), '^\s*(?:#{1,6}|[*+\-]|\p{Nd}+[.)])\s+', ''))) AS l FROM t),
c AS (SELECT item_id, list_filter(list_transform(flatten(list_transform(l, lambda x: string_split(regexp_replace(x, '([.!?])\s+([\p{Lu}\p{Nd}¡¿])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> '') AS c FROM l)
SELECT item_id, CAST(i - 1 AS INTEGER) AS n, c[i] AS claim FROM (SELECT item_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""",
    "cued_questions": _PROPS
    + f""", w AS (SELECT doc_id, pos, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+') AS w FROM typed)
SELECT doc_id, pos, coalesce(w[1] IN ({", ".join(f"'{x}'" for x in answers.OPENERS)}), false) OR len(list_filter([{", ".join(f"'{x}'" for x in _CUES)}], lambda c: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || c || ' '))) > 0 AS leans FROM w""",
    "document_verdicts": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'conflicting' ELSE 'partially_verified' END AS verdict, 0.0::DOUBLE AS score FROM documents""",
    "file_binaries": """
WITH b AS (SELECT DISTINCT generation_id, path, text FROM files WHERE text IS NOT NULL)
SELECT DISTINCT generation_id, path, false AS binary FROM b WHERE NOT contains(text, chr(0)) AND length(regexp_replace(text, '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) <= 0.01 * length(text)""",
}
