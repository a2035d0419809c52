"""Queries of the relational and catalog operators."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators import catalog
from quarrylight.runtime import table

CUTOFF = datetime.datetime(2024, 1, 2)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(table(spark, sf_dir, "documents"), "status")


def type_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(table(spark, sf_dir, "documents"), "mime_type", "status")


def status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type the number of each status, as one row with a column per status."""
    return table(spark, sf_dir, "documents").groupBy("mime_type").pivot("status", ["failed", "parsing", "ready", "registered"]).agg(F.count(F.lit(1))).na.fill(0)


def stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bounds = events.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("cutoff"))
    return events.crossJoin(F.broadcast(bounds)).groupBy("event_type").agg(F.count_if(F.col("ts") < F.col("cutoff")).alias("stale"), F.max("ts").alias("latest"))


def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.unix_micros(F.max(F.when(F.col("status") == "ready", F.col("created_at")))).alias("latest"), F.bool_or(F.col("status") == "failed").alias("has_failed"))


def ready_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a status, newest first, one page."""
    return table(spark, sf_dir, "documents").where("status = 'ready'").orderBy(F.desc("updated_at"), F.desc("doc_id")).offset(20).limit(20).select("doc_id", F.unix_micros("updated_at").alias("updated"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.keyset_page(orders, ["o_custkey", "o_orderkey"], (100, 5), 25)


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_rows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 4).select("user_id", "event_id", "back")


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lead("event_type").over(order).alias("next_type"), F.row_number().over(order).alias("n"))


def retained_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.retained_generations(table(spark, sf_dir, "generations")).select("generation_id", "repository_id", "state")


def active_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_generations(table(spark, sf_dir, "generations"))


def generation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.generation_counts({n: table(spark, sf_dir, n).select("generation_id") for n in ("files", "chunks", "repomap_entries")})


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates_by_content(table(spark, sf_dir, "documents")).select("doc_id", "copies")


def upserted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to generation 50 as the store, later ones as incoming, by path."""
    rows = table(spark, sf_dir, "files").select("generation_id", "path", "content_hash", "captured_at").where("content_hash IS NOT NULL")
    order = [F.desc("generation_id"), F.desc("captured_at"), F.desc("content_hash")]
    store = catalog.first_per(rows.where("generation_id <= 50"), ["path"], order)
    return catalog.upsert_with_reset(store, rows.where("generation_id > 50"), ["path"], "content_hash", order).select("generation_id", "path", "content_hash", "changed")


def files_without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks = table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks")
    return catalog.delete_where(files.select("generation_id", "path").distinct(), chunks, ["generation_id", "path"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each child table after one repository's generations are deleted."""
    gone = table(spark, sf_dir, "generations").where("state = 'abandoned'")
    left = catalog.cascade(gone, {n: (table(spark, sf_dir, n), "generation_id", "generation_id") for n in ("files", "chunks", "repomap_entries", "search_hits")})
    return catalog.generation_counts(left).groupBy("table_name").agg(F.sum("rows").alias("rows"))


def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in pairs of keys: entries whose candidate has a hit."""
    keys = ["query_id", "generation_id", "path"]
    return table(spark, sf_dir, "repomap_entries").select(*keys).distinct().join(table(spark, sf_dir, "search_hits").select(*keys).distinct(), keys, "left_semi")


def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(F.startswith("path", F.lit("src/")) & F.col("language").isin("python", "java")).select("generation_id", "path").distinct()


def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "golden_cases")
    return cases.select("item_id", F.array_join(catalog.merge_lists(F.col("expected_keywords"), F.split("category", "_")), ",").alias("merged"))


def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    active = docs.where("status = 'parsing'").select(F.col("source").alias("target"), F.col("mime_type").alias("job_type"))
    wanted = docs.where("status = 'registered' AND source IS NOT NULL").select(F.col("source").alias("target"), F.col("mime_type").alias("job_type"))
    return catalog.enqueue(active, wanted, ["target", "job_type"])


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join with pre-aggregation: lines to orders, customers, nations."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = lines.join(t("orders").select("o_orderkey", "o_custkey"), lines["l_orderkey"] == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = joined.groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))
    return per.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("revenue", 2).alias("revenue"), "orders")


QUERIES = {
    f.__name__: f
    for f in (
        status_counts, type_status_counts, status_maps, stale_events, latest_success, ready_documents, keyset_page, last_events, next_events, retained_generations, active_generations, generation_counts, content_duplicates,
        upserted_files, files_without_chunks, cascade_delete, scoped_rows, prefix_rows, merged_lists, enqueued, revenue_by_nation,
    )
}

ORACLE = {
    "status_counts": "SELECT status, count(*) AS n FROM documents GROUP BY status",
    "type_status_counts": "SELECT mime_type, status, count(*) AS n FROM documents GROUP BY ALL",
    "status_maps": "SELECT mime_type, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'parsing') AS parsing, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'registered') AS registered FROM documents GROUP BY mime_type",
    "stale_events": "SELECT event_type, count(*) FILTER (ts < (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)) AS stale, max(ts) AS latest FROM events GROUP BY event_type",
    "latest_success": "SELECT source, epoch_us(max(created_at) FILTER (status = 'ready')) AS latest, bool_or(status = 'failed') AS has_failed FROM documents GROUP BY source",
    "ready_documents": "SELECT doc_id, epoch_us(updated_at) AS updated FROM documents WHERE status = 'ready' ORDER BY updated_at DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 20",
    "keyset_page": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 5) ORDER BY o_custkey, o_orderkey LIMIT 25",
    "last_events": "SELECT user_id, event_id, CAST(n AS INTEGER) AS back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 4",
    "next_events": "SELECT event_id, lead(event_type) OVER w AS next_type, CAST(row_number() OVER w AS INTEGER) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "retained_generations": """SELECT generation_id, repository_id, state FROM generations WHERE state = 'active' UNION ALL
SELECT generation_id, repository_id, state FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY generation_id DESC) AS n FROM generations WHERE state = 'complete') WHERE n = 1""",
    "active_generations": "SELECT repository_id, max(generation_id) AS generation_id FROM generations WHERE state = 'active' GROUP BY repository_id",
    "generation_counts": """SELECT 'files' AS table_name, generation_id, count(*) AS rows FROM files GROUP BY ALL UNION ALL SELECT 'chunks', generation_id, count(*) FROM chunks GROUP BY ALL
UNION ALL SELECT 'repomap_entries', generation_id, count(*) FROM repomap_entries GROUP BY ALL""",
    "content_duplicates": """SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies,
  row_number() OVER (PARTITION BY text ORDER BY (coalesce(status, '') = 'failed')::INT, -epoch_us(updated_at) NULLS FIRST, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1""",
    "upserted_files": """
WITH r AS (SELECT generation_id, path, content_hash, captured_at FROM files WHERE content_hash IS NOT NULL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation_id DESC, captured_at DESC, content_hash DESC) AS n FROM r WHERE generation_id <= 50) WHERE n = 1),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation_id DESC, captured_at DESC, content_hash DESC) AS n FROM r WHERE generation_id > 50) WHERE n = 1)
SELECT s.generation_id, s.path, s.content_hash, false AS changed FROM s ANTI JOIN i USING (path)
UNION ALL SELECT i.generation_id, i.path, i.content_hash, s.path IS NULL OR s.content_hash <> i.content_hash FROM i LEFT JOIN s USING (path)""",
    "files_without_chunks": "SELECT DISTINCT generation_id, path FROM files ANTI JOIN chunks USING (generation_id, path)",
    "cascade_delete": """WITH g AS (SELECT generation_id FROM generations WHERE state = 'abandoned') SELECT 'files' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM files ANTI JOIN g USING (generation_id)
UNION ALL SELECT 'chunks', count(*) FROM chunks ANTI JOIN g USING (generation_id) UNION ALL SELECT 'repomap_entries', count(*) FROM repomap_entries ANTI JOIN g USING (generation_id) UNION ALL SELECT 'search_hits', count(*) FROM search_hits ANTI JOIN g USING (generation_id)""",
    "scoped_rows": "SELECT DISTINCT query_id, generation_id, path FROM repomap_entries SEMI JOIN search_hits USING (query_id, generation_id, path)",
    "prefix_rows": "SELECT DISTINCT generation_id, path FROM files WHERE starts_with(path, 'src/') AND language IN ('python', 'java')",
    "enqueued": """SELECT DISTINCT source AS target, mime_type AS job_type FROM documents d WHERE status = 'registered' AND source IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM documents a WHERE a.status = 'parsing' AND a.source = d.source AND a.mime_type = d.mime_type)""",
    "revenue_by_nation": """SELECT n_name, round(sum(r), 2) AS revenue, count(*) AS orders FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY l_orderkey)
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
