"""Queries of the text functions and of document enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import routing, text
from quarrylight.operators import chunking, enrich
from quarrylight.runtime import table
from quarrylight.sources import documents as parsers


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_cases")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(text.tokens(F.col("title"))).alias("token")).distinct()
    return words.select("token", text.token_hash(F.col("token")).alias("hash"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.propositions(_docs(spark, sf_dir))


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.document_edges(enrich.propositions(_docs(spark, sf_dir)))


def keyword_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.keyword_graph(enrich.propositions(_docs(spark, sf_dir)))


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.document_summaries(_docs(spark, sf_dir))


def collection_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    summaries = enrich.document_summaries(docs, 3).join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    return enrich.collection_memory(summaries, "source")


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences for each section of each document, and the nodes they were drawn from."""
    return enrich.section_summaries(table(spark, sf_dir, "document_nodes"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text IS NOT NULL").select(
        "doc_id", text.estimate_quarter(F.col("text")).alias("quarter"), text.estimate_bytes(F.col("text")).alias("bytes"), text.estimate_words(F.col("title"), F.lit("")).alias("words")
    )


def even_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", text.even_spaces(F.col("text")).alias("text"))


def without_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", text.without_envelope(F.col("text")).alias("kept"))


def term_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.term_reference(F.col("text")), " ").alias("terms"))


def contradiction_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = enrich.propositions(_docs(spark, sf_dir))
    return props.groupBy(text.contradicts(F.col("sentence")).alias("contradicts"), "kind").agg(F.count("*").alias("n"))


def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("title IS NOT NULL").select("doc_id", text.slug(F.col("title")).alias("slug"))


def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).select("item_id", F.size(text.claims(F.col("expected_answer"))).alias("claims"))


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = routing.features(F.col("question"))
    return _golden(spark, sf_dir).select("item_id", routing.route(f).alias("route"), routing.intent(f).alias("intent"), f["clauses"].alias("clauses"), f["comparison"].alias("comparison"))


def question_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).select("item_id", routing.question_language(F.col("question")).alias("language"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).select("item_id", F.round(text.overlap(F.col("question"), F.col("expected_answer")), 9).alias("overlap"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(_docs(spark, sf_dir), most=120, overlap=12)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_chunks(table(spark, sf_dir, "document_nodes"))


def parsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_documents(_docs(spark, sf_dir))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text IS NOT NULL").groupBy(parsers.looks_like_transcript(F.col("text")).alias("transcript")).agg(F.count("*").alias("n"))


def folded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("title IS NOT NULL").select("doc_id", text.fold_accents(F.col("title")).alias("folded"))


def title_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("title IS NOT NULL").select("doc_id", text.string_number(F.col("title")).alias("number"))


QUERIES = {
    f.__name__: f
    for f in (
        document_tokens, token_hashes, document_sentences, propositions, document_edges, keyword_graph, document_summaries, collection_memory, section_summaries, token_estimates, even_spaces, without_envelope, term_references,
        contradiction_sentences, title_slugs, claim_counts, question_routes, question_languages, overlaps, split_documents, document_chunks, parsed_nodes, transcripts, folded_titles, title_numbers,
    )
}

_SPACE = "\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_TOKENS = "list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}_\\-]+'), lambda w: length(w) > 2), lambda w: translate(lower(w), 'áéíóúü', 'aeiouu'))"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20)"
_KIND = """CASE WHEN regexp_matches(lower({0}), 'is defined as|means|se define|defined as') THEN 'definition'
  WHEN regexp_matches(lower({0}), 'must|should|debe|shall|required') THEN 'rule'
  WHEN regexp_matches(lower({0}), 'because|causes|leads to|provoca|por eso') THEN 'causal'
  WHEN regexp_matches(lower({0}), 'step|first|second|procedure|proceso|instrucción') THEN 'procedure'
  WHEN regexp_matches(lower({0}), 'vs|versus|compare|diferencia|better|mejor') THEN 'comparison' ELSE 'fact' END"""
_PROPS = f"""
WITH found AS (SELECT doc_id, title, {_SENTENCES.format("text")} AS s FROM documents),
filled AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s WHEN title IS NOT NULL THEN [title] ELSE [] END AS s FROM found),
props AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM filled)),
typed AS (SELECT *, {_KIND.format("sentence")} AS kind FROM props)
"""


def _cue(feature: str, column: str) -> str:
    single = [c for c in routing.CUES[feature] if " " not in c]
    phrases = [c for c in routing.CUES[feature] if " " in c]
    words = ", ".join(f"'{c}'" for c in single)
    out = f"list_has_any(words, [{words}])"
    if phrases:
        out += f" OR regexp_matches(' ' || low || ' ', '[^\\p{{L}}\\p{{N}}_]({'|'.join(phrases)})[^\\p{{L}}\\p{{N}}_]')"
    return f"({out}) AS {column}"


_ROUTED = f"""
WITH q AS (SELECT item_id, question, regexp_replace(lower(trim(question)), '\\s+', ' ', 'g') AS low FROM golden_cases),
w AS (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_\\-]+') AS words FROM q),
f AS (SELECT item_id, {", ".join(_cue(n, "c_" + n) for n in routing.CUES)},
  len(list_filter(words, lambda x: length(x) >= 8 AND regexp_matches(x, '[0-9]'))) > 0 AS long_number,
  contains(low, ' and ') OR contains(low, ' y ') OR contains(low, ',') OR contains(low, ';') AS clauses FROM w)
"""

ORACLE = {
    "claim_counts": r"""
WITH l AS (SELECT item_id, list_transform(string_split(coalesce(expected_answer, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\r$', ''), '^\s*(?:#{1,6}|[*+\-]|\p{Nd}+[.)])\s+', ''))) AS l FROM golden_cases)
SELECT item_id, CAST(len(list_filter(list_transform(flatten(list_transform(l, lambda x: string_split(regexp_replace(x, '([.!?])\s+([\p{Lu}\p{Nd}¡¿])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS claims FROM l""",
    "document_tokens": f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens FROM documents",
    "token_hashes": f"SELECT DISTINCT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS hash FROM (SELECT unnest({_TOKENS.format('title')}) AS token FROM documents)",
    "document_sentences": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents))",
    "propositions": _PROPS + "SELECT doc_id, pos, sentence, kind FROM typed",
    "document_edges": _PROPS
    + """, near AS (SELECT doc_id, pos, lead(pos) OVER w AS nxt, lead(kind) OVER w AS next_kind FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CAST(NULL AS INTEGER) AS "to", 'appears_in' AS relation, 1.0::DOUBLE AS weight FROM typed
UNION ALL SELECT doc_id, pos, nxt, CASE next_kind WHEN 'definition' THEN 'defines' WHEN 'causal' THEN 'causes' ELSE 'supports' END, 0.8 FROM near WHERE nxt IS NOT NULL""",
    "token_estimates": """SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS INTEGER)) AS quarter, CAST(ceil(octet_length(encode(text)) / 3) AS INTEGER) AS bytes,
  CAST(len(list_filter(regexp_split_to_array(coalesce(title, ''), '\\s+'), lambda w: w <> '')) + 12 AS INTEGER) AS words FROM documents WHERE text IS NOT NULL""",
    "even_spaces": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), chr(10)) AS text FROM documents WHERE text IS NOT NULL",
    "without_envelope": f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '' AND x <> '-----' AND NOT regexp_matches(lower(x), '^(?:{"|".join(text.ENVELOPE_PREFIXES)})')), ' ') AS kept FROM documents WHERE text IS NOT NULL""",
    "term_references": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS.format('text')}, lambda w: length(w) > 3)))[1:32], ' ') AS terms FROM documents",
    "contradiction_sentences": _PROPS + "SELECT regexp_matches(lower(sentence), 'however|but|sin embargo|no obstante|contradict') AS contradicts, kind, count(*) AS n FROM typed GROUP BY ALL",
    "title_slugs": "SELECT doc_id, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}\\s\\-_]', '', 'g'), '\\s+', '-', 'g') AS slug FROM documents WHERE title IS NOT NULL",
    "question_routes": _ROUTED
    + """SELECT item_id, CASE WHEN c_visual THEN 'visual' WHEN c_global THEN 'global' WHEN c_contradiction OR c_argument THEN 'argumentative' WHEN c_stance THEN 'multi_hop'
  WHEN c_exact OR long_number THEN 'exact' WHEN c_comparison OR clauses THEN 'multi_hop' ELSE 'factual_local' END AS route,
  CASE WHEN c_visual THEN 'visual' WHEN c_global THEN 'global' WHEN c_contradiction OR c_argument OR c_stance THEN 'argumentative' WHEN c_comparison THEN 'comparative' WHEN c_exact OR long_number THEN 'exact' ELSE 'factual' END AS intent,
  clauses, c_comparison AS comparison FROM f""",
    "overlaps": f"""SELECT item_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 9) AS overlap
FROM (SELECT item_id, list_distinct({_TOKENS.format('question')}) AS q, {_TOKENS.format('expected_answer')} AS t FROM golden_cases)""",
    "transcripts": """SELECT len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\[?([0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}([.,][0-9]+)?\\]?'))) > 0
  OR (len(l) >= 8 AND len(list_filter(l, lambda x: length(x) <= 180)) >= 0.8 * len(l)) AS transcript, count(*) AS n
FROM (SELECT list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL) GROUP BY ALL""",
    "question_languages": f"""
WITH w AS (SELECT item_id, lower(question) AS low, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_\\-]+') AS words FROM golden_cases),
s AS (SELECT item_id, low, len(list_filter(words, lambda x: x IN ({", ".join(f"'{x}'" for x in routing.SPANISH)}))) + (len(list_filter(words, lambda x: regexp_matches(x, '(ción|ciones|mente|idad|ario|aria)$'))) > 0)::INT AS es,
  len(list_filter(words, lambda x: x IN ({", ".join(f"'{x}'" for x in routing.ENGLISH)}))) AS en FROM w)
SELECT item_id, CASE WHEN regexp_matches(low, '[áéíóúñ¿¡]') THEN 'es' WHEN es >= en THEN 'es' ELSE 'en' END AS language FROM s""",
    "title_numbers": """SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS number
FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256(title), 49, 16) AS UBIGINT) AS HUGEINT) AS u FROM documents WHERE title IS NOT NULL)""",
    "folded_titles": "SELECT doc_id, strip_accents(lower(title)) AS folded FROM documents WHERE title IS NOT NULL",
}
