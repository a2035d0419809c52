"""Queries of the snapshot and hierarchy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.operators.hierarchy import hierarchy
from quarrylight.operators.snapshots import file_changes
from quarrylight.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_changes(table(spark, sf_dir, "files"), table(spark, sf_dir, "generations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "document_nodes").select("id", "document_id", "parent_id", "order_index", "ingested_at")
    return hierarchy(nodes, with_path=False).select("id", "root_id", "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "document_nodes").select("id", "document_id", "parent_id", "order_index", "ingested_at")
    return hierarchy(nodes, with_counts=True).select("id", "root_id", "depth", "path", "descendants")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_paths": p5_paths}

_SNAPSHOT_ROWS = r"""
WITH chain AS (
  SELECT generation_id,
         lag(generation_id) OVER (PARTITION BY repository_id ORDER BY generation_id) AS before_id,
         lead(generation_id) OVER (PARTITION BY repository_id ORDER BY generation_id) AS after_id
  FROM (SELECT DISTINCT generation_id, repository_id FROM generations WHERE state IN ('complete', 'active'))
), spelt AS (
  SELECT f.generation_id, c.before_id, c.after_id, f.captured_at,
         nfc_normalize(array_to_string(list_filter(string_split(replace(f.path, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'), '/')) AS path,
         coalesce(regexp_replace(lower(trim(f.content_hash)), '^sha-?256[:=-]\s*', ''), sha256(f.text)) AS digest
  FROM files f JOIN chain c USING (generation_id)
), latest AS (
  SELECT generation_id, before_id, after_id, path, arg_max(digest, (captured_at, digest)) AS digest
  FROM spelt GROUP BY ALL
)
"""

_TREE = """
WITH RECURSIVE latest AS (
  SELECT id, arg_max(coalesce(lower(trim(parent_id)), ''), (ingested_at, coalesce(lower(trim(parent_id)), ''))) AS parent,
         arg_max(coalesce(document_id, ''), (ingested_at, coalesce(lower(trim(parent_id)), ''))) AS doc
  FROM document_nodes WHERE id IS NOT NULL GROUP BY id
), linked AS (
  SELECT a.id, b.id AS up FROM latest a LEFT JOIN latest b ON a.doc = b.doc AND a.parent = lower(trim(b.id))
), walk AS (
  SELECT id, id AS here, 0 AS depth, [id] AS seen, false AS looped FROM linked
  UNION ALL
  SELECT w.id, l.up, w.depth + 1, list_append(w.seen, l.up), list_contains(w.seen, l.up)
  FROM walk w JOIN linked l ON l.id = w.here WHERE l.up IS NOT NULL AND NOT w.looped
), ended AS (
  SELECT id, arg_max(here, depth) AS here, max(depth) AS depth, arg_max(seen, depth) AS seen, bool_or(looped) AS looped FROM walk GROUP BY id
), tree AS (
  SELECT id,
         CASE WHEN looped THEN list_min(seen[list_position(seen, here):]) ELSE here END AS root_id,
         CAST(CASE WHEN looped THEN -1 ELSE depth END AS INTEGER) AS depth,
         CASE WHEN NOT looped THEN list_reverse(seen) END AS path
  FROM ended
)
"""

ORACLE = {
    "p3_found": _SNAPSHOT_ROWS
    + """
SELECT generation_id, path, CASE WHEN o_path IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM (SELECT n.generation_id, n.path, n.digest, o.path AS o_path, o.digest AS o_digest
      FROM latest n LEFT JOIN latest o ON o.generation_id = n.before_id AND o.path = n.path
      WHERE n.before_id IS NOT NULL)
WHERE o_path IS NULL OR digest IS DISTINCT FROM o_digest
UNION ALL
SELECT o.after_id, o.path, 'removed'
FROM latest o LEFT JOIN latest n ON n.generation_id = o.after_id AND n.path = o.path
WHERE o.after_id IS NOT NULL AND n.path IS NULL
""",
    "p5_found": _TREE + "SELECT id, root_id, depth FROM tree",
    "p5_paths": _TREE
    + """
, below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(path[1:-2]) AS a FROM tree WHERE path IS NOT NULL) GROUP BY a)
SELECT t.id, t.root_id, t.depth, t.path, coalesce(b.n, 0) AS descendants FROM tree t LEFT JOIN below b USING (id)
""",
}
