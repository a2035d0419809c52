"""Queries over source files: admission, extraction, search, graph, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import catalog, chunking, config, extract, graph, lexical
from quarrylight.plans import lifecycle
from quarrylight.runtime import cut, table
from quarrylight.sources import admission

def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows of each repository's active generation, as one tree per repository."""
    active = catalog.active_generations(table(spark, sf_dir, "generations"))
    rows = _files(spark, sf_dir).join(active.select("generation_id"), "generation_id", "left_semi")
    return catalog.first_per(rows, ["generation_id", "path"], [F.desc("captured_at"), F.desc("content_hash")])


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", admission.language_of(F.col("path")).alias("language")).distinct()


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(admission.holds_secret(F.col("text"))).select("generation_id", "path").distinct()


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", admission.is_safe(F.col("path")).alias("safe")).distinct()


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of each path that are binary or not."""
    return _files(spark, sf_dir).where("text IS NOT NULL").select("path", F.sha2("text", 256).alias("digest"), admission.is_binary(F.encode("text", "UTF-8")).alias("binary")).distinct()


def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = admission.admission(_files(spark, sf_dir).select("path", "size"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "size", F.col("content_hash").alias("checksum"), "generation_id").where("checksum IS NOT NULL")
    rows = files.groupBy("path", "checksum").agg(F.min("size").alias("size"))
    known = files.where("generation_id <= 10").select("checksum")
    return admission.import_outcomes(rows, known).groupBy("outcome").agg(F.count("*").alias("n"))


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("path", text.looks_like_test(p).alias("is_test"), text.looks_like_test_in_search(p).alias("in_search"), text.bucket_of(p).alias("bucket"), text.top_directory(p).alias("top")).distinct()


def file_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.histograms(_files(spark, sf_dir).select("path", "language"))


def exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.exact_hits(_files(spark, sf_dir), "limit").distinct()


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ranking_queries").select("query_id", F.col("focus_text").alias("query"))


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every query of ranking_queries among the chunks and the live files."""
    return lexical.search_code(table(spark, sf_dir, "chunks"), _live(spark, sf_dir), _searches(spark, sf_dir))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searches(spark, sf_dir).select("query_id", F.posexplode(lexical.query_terms(F.col("query"))).alias("place", "term")).distinct()


def literal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files that hold the first word of a query literally."""
    words = _searches(spark, sf_dir).select("query_id", F.regexp_extract("query", r"[\p{L}\p{N}_]{4,}", 0).alias("query")).where("query <> ''").distinct()
    return lexical.literal_hits(_live(spark, sf_dir), words)


def plan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both plans of each query hand on, with their weight."""
    return lexical.matching_ids(table(spark, sf_dir, "chunks"), _searches(spark, sf_dir))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["generation_id", "id"])
    return lexical.index_terms(chunks, ["path", "heading", "content"], ["generation_id", "id"]).groupBy("term").agg(F.count("*").alias("items"), F.sum("tf").alias("occurrences"))


def code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.code_chunks(_files(spark, sf_dir))


def lexical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lexical_chunks(_files(spark, sf_dir).where("language IS NULL OR language NOT IN ('python', 'javascript', 'typescript', 'java', 'sql', 'markdown', 'json', 'toml', 'yaml')"))


def source_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.source_admission(_files(spark, sf_dir).select("generation_id", "path", "size", "text")).select("generation_id", "path", "reason").distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols(_files(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.edges(_files(spark, sf_dir))


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.edges(_files(spark, sf_dir)).groupBy("relation").agg(F.count("*").alias("n"))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _live(spark, sf_dir)
    edges = extract.edges(files).withColumn("target_symbol_id", F.lit(None).cast("string"))
    named = graph.resolve_names(edges, extract.symbols(files))
    return named.groupBy("relation").agg(F.count("*").alias("n"), F.count("resolved_id").alias("resolved"))


def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.file_links(_live(spark, sf_dir))


def chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "chunks").select("generation_id", "path", "id", F.col("line_start").alias("line")).distinct()
    return graph.containing_symbol(points, extract.symbols(_live(spark, sf_dir)), ["generation_id", "path"])


def file_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centrality of each file within its own repository."""
    files = cut(_live(spark, sf_dir).select("generation_id", "path", "language", "text", "content_hash"))
    ranks = graph.page_rank(files.select(F.col("generation_id").cast("string").alias("graph"), F.col("path").alias("node")), lifecycle.file_links(files))
    return ranks.select(F.col("graph").cast("int").alias("generation_id"), F.col("node").alias("path"), F.round("rank", 9).alias("rank"))


def repository_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cut(_live(spark, sf_dir))
    return lifecycle.overview(files, "merge token", 2_000)


def link_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers within two steps of nation 7, over trade of lines and orders by nation."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    edges = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.lit(1.0).alias("weight")).unionByName(
        customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit(1.0).alias("weight"))
    )
    return graph.expand(edges, spark.createDataFrame([("s7",)], "node string"), 2)


def _targets(links: DataFrame) -> DataFrame:
    """The file of each repository that most others lead to."""
    many = links.groupBy("graph", "target").agg(F.count_distinct("source").alias("n"))
    return catalog.first_per(many, ["graph"], [F.desc("n"), F.col("target")]).select("graph", "target")


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(lifecycle.file_links(_live(spark, sf_dir)))
    return graph.impact(links, _targets(links))


def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.affected(impact(spark, sf_dir))


def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the source files of each repository."""
    files = cut(_live(spark, sf_dir))
    at = F.col("generation_id").cast("string").alias("graph")
    sources = files.select(at, F.col("path").alias("target")).where(~text.looks_like_test(F.col("target"))).distinct()
    return graph.related_tests(files.select(at, "path"), lifecycle.file_links(files), sources)


def generation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fingerprint(_files(spark, sf_dir))


def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.first_per(_files(spark, sf_dir).select("generation_id", "path", "content_hash", "captured_at"), ["generation_id", "path"], [F.desc("captured_at"), F.desc("content_hash")])
    chunks = table(spark, sf_dir, "chunks").select("id", "generation_id", "path").distinct()
    return chunks.join(files, ["generation_id", "path"]).select("id", "generation_id", "path", "content_hash")


def published_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").select("query_id", "generation_id", F.col("path").alias("item_id")).distinct()
    files = _files(spark, sf_dir).select(F.col("path").alias("id"), "generation_id")
    active = catalog.active_generations(table(spark, sf_dir, "generations"))
    return catalog.rehydrate(hits, files, active).groupBy("reason").agg(F.count("*").alias("n"))


def flat_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.flat_config(_files(spark, sf_dir))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.landmarks(_files(spark, sf_dir))


def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.duplicate_ids(table(spark, sf_dir, "chunks"), ["generation_id", "id"])


def order_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a nation with supplier 7, as a walk over two relations."""
    supplier = table(spark, sf_dir, "supplier")
    a = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.lit("in").alias("relation"))
    return graph.traverse(a, "s7", direction="both", depth=2, relations=["in"])


QUERIES = {
    f.__name__: f
    for f in (
        file_languages, secret_files, safe_paths, binary_files, admission_reasons, import_outcomes, test_paths, file_histograms, exact_hits, code_search, search_terms, literal_hits, plan_hits, index_terms, code_spans, lexical_chunks, source_reasons, symbols, relations, relation_counts,
        resolved_names, file_links, chunk_symbols, file_ranks, repository_map, link_expansion, impact, affected_files, related_tests, generation_fingerprints, chunk_hashes, published_hits, flat_configs, landmarks, repeated_chunks, order_traversal,
    )
}

_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in admission.LANGUAGES.items()) + "}"
_NAME = "string_split(path, '/')[-1]"
_LOCKS = ", ".join(f"'{x}'" for x in admission.LOCK_FILES)
_SAFE = "(NOT regexp_matches(path, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)') AND trim(path) <> '')"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)

_LIVE = """
WITH a AS (SELECT max(generation_id) AS generation_id FROM generations WHERE state = 'active' GROUP BY repository_id),
live AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.generation_id, path ORDER BY captured_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS nth FROM files f JOIN a USING (generation_id)) WHERE nth = 1)"""
_WIDER = "MAP {" + ", ".join(f"'{k}': [{_IN(v)}]" for k, v in lexical.SYNONYMS.items()) + "}"
_TERMS = f"""
WITH asked_once AS (SELECT query_id, max(focus_text) AS query FROM ranking_queries WHERE query_id IS NOT NULL GROUP BY 1),
raw AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_.:/@\\-]+'), lambda w: regexp_replace(w, '^[.:/@\\-]+|[.:/@\\-]+$', '', 'g')), lambda w: w <> '') AS w FROM asked_once),
kept AS (SELECT query_id, CASE WHEN len(list_filter(w, lambda x: NOT list_contains([{_IN(lexical.STOPWORDS)}], lower(x)))) > 0 THEN list_filter(w, lambda x: NOT list_contains([{_IN(lexical.STOPWORDS)}], lower(x))) ELSE w END AS w FROM raw),
wide AS (SELECT query_id, i, p, k, term FROM (SELECT query_id, i, unnest([1, 2, 3]) AS p, w[i] AS x FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM kept)), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k, unnest(l) AS term FROM (SELECT CASE p WHEN 1 THEN [x] WHEN 2 THEN
  CASE WHEN len(list_filter(regexp_split_to_array(x, '[/:.\\-]+'), lambda y: length(y) > 1)) > 1 THEN list_filter(regexp_split_to_array(x, '[/:.\\-]+'), lambda y: length(y) > 1) ELSE [] END
  ELSE flatten(list_transform(list_concat([x], list_filter(regexp_split_to_array(x, '[/:.\\-]+'), lambda y: length(y) > 1)), lambda c: coalesce({_WIDER}[lower(c)], []))) END AS l))),
firsts AS (SELECT query_id, term, min((i, p, k)) AS first FROM wide GROUP BY ALL), terms AS (SELECT query_id, list(term ORDER BY first) AS t FROM firsts GROUP BY query_id)
"""

ORACLE = {
    "file_languages": f"""SELECT DISTINCT path, CASE WHEN {_NAME} IN ('Dockerfile', 'Containerfile') THEN 'dockerfile' WHEN lower({_NAME}) IN ({_LOCKS}) THEN 'lockfile'
  ELSE coalesce({_LANG}[lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1))], 'text') END AS language FROM files""",
    "secret_files": "SELECT DISTINCT generation_id, path FROM files WHERE regexp_matches(substr(text, 1, 256000), '" + "|".join(admission.SECRETS) + "')",
    "safe_paths": f"SELECT DISTINCT path, {_SAFE} AS safe FROM files",
    "admission_reasons": f"""
WITH f AS (SELECT path, size, lower({_NAME}) AS name, lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1)) AS ext, string_split(lower(path), '/')[1:-2] AS dirs FROM files)
SELECT CASE WHEN NOT {_SAFE} THEN 'outside_source_root' WHEN list_has_any(dirs, [{_IN(admission.SKIPPED_DIRECTORIES)}]) THEN 'excluded_directory' WHEN name IN ({_IN(admission.ADMINISTRATIVE)}) THEN 'excluded_administrative_file'
  WHEN starts_with(name, '~$') OR starts_with(name, '.~lock.') THEN 'excluded_sidecar_file' WHEN ext IN ({_IN(admission.ARCHIVES)}) THEN 'excluded_archive' WHEN ext IN ({_IN(admission.SIDECARS)}) THEN 'excluded_sidecar_file'
  WHEN ext NOT IN ({_IN(admission.DOCUMENT_SUFFIXES)}) THEN 'unsupported_extension' WHEN size > 104857600 THEN 'file_too_large' END AS reason, count(*) AS n FROM f GROUP BY 1""",
    "test_paths": """SELECT DISTINCT path, regexp_matches(lower(path), '(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|\\.(test|spec)\\.[^/]*$|_test\\.py$') AS is_test,
  regexp_matches(lower(path), '(^|/)(tests|__tests__)/|\\.test\\.|\\.spec\\.') AS in_search,
  array_to_string(string_split(path, '/')[1:CASE WHEN string_split(path, '/')[1] IN ('apps', 'packages') AND len(string_split(path, '/')) >= 6 THEN 5
    WHEN string_split(path, '/')[1] IN ('apps', 'packages') AND len(string_split(path, '/')) >= 2 THEN least(4, len(string_split(path, '/')) - 1) ELSE 1 END], '/') AS bucket,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS top FROM files""",
    "file_histograms": """SELECT * FROM (SELECT 'language' AS what, language AS value, count(*) AS n FROM files GROUP BY language ORDER BY n DESC, value NULLS FIRST LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'directory' AS what, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS value, count(*) AS n FROM files GROUP BY 2 ORDER BY n DESC, value LIMIT 12)""",
    "exact_hits": """SELECT DISTINCT generation_id, path, CAST((length(text) - length(replace(text, 'limit', ''))) // 5 AS BIGINT) AS occurrences, 5.0 + 0.05 * least((length(text) - length(replace(text, 'limit', ''))) // 5, 20) AS score,
  CAST(len(string_split(substr(text, 1, instr(text, 'limit') - 1), chr(10))) AS INTEGER) AS line_no FROM files WHERE instr(text, 'limit') > 0""",
    "index_terms": """
WITH c AS (SELECT DISTINCT ON (generation_id, id) * FROM chunks), w AS (SELECT generation_id, id, unnest(list_transform(regexp_extract_all(concat_ws(' ', path, coalesce(heading, ''), coalesce(content, '')), '[\\p{L}\\p{N}_]+'), lambda x: lower(x))) AS term FROM c)
SELECT term, count(*) AS items, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT generation_id, id, term, count(*) AS tf FROM w GROUP BY ALL) GROUP BY term""",
    "source_reasons": f"""WITH f AS (SELECT generation_id, path, size, text, replace(path, chr(92), '/') AS p, lower({_NAME}) AS name, lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1)) AS ext FROM files)
SELECT DISTINCT generation_id, path, CASE WHEN p = '' OR starts_with(p, '/') OR regexp_matches(p, '^.:') OR list_contains(string_split(p, '/'), '..') THEN 'excluded_path_escape' WHEN list_has_any(string_split(p, '/'), [{_IN(admission.SOURCE_SKIPPED)}]) THEN 'excluded_path'
  WHEN name IN ({_IN(admission.SECRET_NAMES)}, '.env', 'credentials', 'secrets') OR starts_with(name, '.env.') OR ext IN ({_IN(admission.SECRET_SUFFIXES)}) THEN 'excluded_secret' WHEN name IN ({_IN(admission.GENERATED_NAMES)}) THEN 'excluded_generated'
  WHEN ext IN ({_IN(admission.BINARY_SUFFIXES)}) THEN 'excluded_binary' WHEN size > 2000000 THEN 'excluded_large_file' WHEN coalesce(regexp_matches(substr(text, 1, 256000), '{"|".join(admission.SECRETS)}'), false) THEN 'excluded_secret_content' END AS reason FROM f""",
    "binary_files": """SELECT DISTINCT path, sha256(text) AS digest, contains(substr(text, 1, 8192), chr(0)) OR length(regexp_replace(substr(text, 1, 8192), '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) > 0.15 * greatest(1, least(8192, octet_length(encode(text)))) AS "binary" FROM files WHERE text IS NOT NULL""",
    "search_terms": _TERMS + "SELECT DISTINCT query_id, CAST(i - 1 AS INTEGER) AS place, t[i] AS term FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM terms)",
    "literal_hits": _LIVE
    + """, w AS (SELECT DISTINCT query_id, regexp_extract(focus_text, '[\\p{L}\\p{N}_]{4,}') AS query FROM ranking_queries), q AS (SELECT DISTINCT query FROM w WHERE query <> ''),
h AS (SELECT query, generation_id, path, CAST((length(text) - length(replace(text, query, ''))) // length(query) AS BIGINT) AS occurrences, CAST(len(string_split(substr(text, 1, instr(text, query) - 1), chr(10))) AS INTEGER) AS line_no FROM q JOIN live ON contains(text, query))
SELECT query_id, generation_id, path, occurrences, line_no FROM h JOIN w USING (query)""",
    "plan_hits": _TERMS
    + """, asked AS (SELECT query_id, len(t) AS wanted, unnest(t) AS term FROM terms), bare AS (SELECT query_id, wanted, term, regexp_replace(lower(term), '[^\\p{L}\\p{N}_]', '', 'g') AS b FROM asked WHERE regexp_replace(lower(term), '[^\\p{L}\\p{N}_]', '', 'g') <> ''),
c AS (SELECT DISTINCT generation_id, id, path, kind, line_start, line_end, lower(concat_ws(' ', path, coalesce(heading, ''), coalesce(content, ''))) AS body FROM chunks WHERE id IS NOT NULL AND path IS NOT NULL),
w AS (SELECT generation_id, id, len(x) AS n, unnest(x) AS word FROM (SELECT generation_id, id, regexp_extract_all(body, '[\\p{L}\\p{N}_]+') AS x FROM c)),
tf AS (SELECT generation_id, id, n, b, count(*) AS tf FROM w JOIN (SELECT DISTINCT b FROM bare) s ON starts_with(word, b) GROUP BY ALL),
f AS (SELECT query_id, wanted, generation_id, id, n, term, max(tf) AS tf FROM tf JOIN bare USING (b) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM f GROUP BY ALL),
m AS (SELECT query_id, count(*) AS matched, avg(n) AS mean FROM (SELECT DISTINCT query_id, generation_id, id, n FROM f) GROUP BY 1),
s AS (SELECT query_id, generation_id, id, round(sum(ln(1 + (matched - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS weight, count(*) = max(wanted) AS strict FROM f JOIN df USING (query_id, term) JOIN m USING (query_id) GROUP BY query_id, generation_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, generation_id, id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY strict DESC, weight DESC, generation_id, id) AS b FROM s)
SELECT DISTINCT query_id, generation_id, id, weight, strict FROM r WHERE a <= 500 OR strict AND b <= 500""",
    "link_expansion": """
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT 's7' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM walk JOIN both_ways ON a = node WHERE distance < 2)
SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node""",
    "landmarks": f"""SELECT generation_id, path, role, CAST(n AS INTEGER) AS rank FROM (SELECT generation_id, path, CASE WHEN b THEN 'test' WHEN a THEN 'entry_or_manifest' ELSE 'source' END AS role,
  row_number() OVER (PARTITION BY generation_id ORDER BY NOT a, b, path) AS n FROM (SELECT DISTINCT generation_id, path, lower({_NAME}) IN ({_IN(config.PREFERRED)}) AS a,
  regexp_matches(lower(path), '(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|\\.(test|spec)\\.[^/]*$|_test\\.py$') AS b FROM files)) WHERE n <= 20""",
    "repeated_chunks": "SELECT generation_id, id, count(*) AS n FROM chunks GROUP BY ALL HAVING count(*) > 1",
    "order_traversal": """
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT 's7' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM walk JOIN w ON a = node WHERE distance < 2), m AS (SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node)
SELECT node, distance FROM m WHERE distance > 0 ORDER BY distance, node LIMIT 200""",
    "chunk_hashes": """
WITH f AS (SELECT generation_id, path, content_hash, row_number() OVER (PARTITION BY generation_id, path ORDER BY captured_at DESC, content_hash DESC NULLS LAST) AS n FROM files)
SELECT DISTINCT c.id, c.generation_id, c.path, f.content_hash FROM chunks c JOIN f ON f.generation_id = c.generation_id AND f.path = c.path AND f.n = 1""",
    "published_hits": """
WITH h AS (SELECT DISTINCT query_id, generation_id, path FROM search_hits), a AS (SELECT max(generation_id) AS generation_id FROM generations WHERE state = 'active' GROUP BY repository_id), k AS (SELECT DISTINCT path, generation_id FROM files)
SELECT CASE WHEN a.generation_id IS NULL THEN 'stale' WHEN k.path IS NULL THEN 'missing' ELSE 'accepted' END AS reason, count(*) AS n FROM h LEFT JOIN a USING (generation_id) LEFT JOIN k ON k.path = h.path AND k.generation_id = h.generation_id GROUP BY 1""",
    "generation_fingerprints": """
WITH r AS (SELECT DISTINCT generation_id, path, content_hash, git_status FROM files), h AS (SELECT generation_id, sha256(concat_ws(chr(0), path, content_hash, coalesce(git_status, ''))) AS d FROM r)
SELECT generation_id, sha256(CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)::HUGEINT) AS VARCHAR) || ':' || count(*)) AS fingerprint FROM h GROUP BY generation_id""",
    "import_outcomes": f"""
WITH f AS (SELECT path, content_hash AS checksum, min(size) AS size, lower({_NAME}) AS name, lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1)) AS ext, string_split(lower(path), '/')[1:-2] AS dirs FROM files WHERE content_hash IS NOT NULL GROUP BY path, content_hash),
m AS (SELECT *, NOT {_SAFE} OR list_has_any(dirs, [{_IN(admission.SKIPPED_DIRECTORIES)}]) OR name IN ({_IN(admission.ADMINISTRATIVE)}) OR ext NOT IN ({_IN(admission.DOCUMENT_SUFFIXES)}) OR size > 104857600 AS skipped FROM f),
k AS (SELECT DISTINCT content_hash AS checksum FROM files WHERE generation_id <= 10 AND content_hash IS NOT NULL), p AS (SELECT checksum, min(path) AS first_path FROM m WHERE NOT skipped GROUP BY checksum)
SELECT CASE WHEN skipped THEN 'skipped' WHEN k.checksum IS NOT NULL OR path <> first_path THEN 'deduplicated' ELSE 'created' END AS outcome, count(*) AS n FROM m LEFT JOIN k USING (checksum) LEFT JOIN p USING (checksum) GROUP BY 1""",
}
