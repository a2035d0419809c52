"""What changed between consecutive full snapshots of a keyed table.

Each row is reduced to two 64-bit numbers, a key hash and a row hash. Buckets
of the key hash are compared in numpy: the arrays of two consecutive snapshots
are sorted and their set differences taken by binary search. Full keys are
fetched afterwards, for the differing hashes only.

Defined cases: an empty snapshot between two others removes everything and the
next one adds it again; repeated rows count once; of several deliveries the one
with the latest ``order_by`` stands (ties: the greater row value); null keys are
ignored; the first snapshot has no changes; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.paths import canonical_digest, canonical_path
from quarrylight.runtime import cut, parallelism

ROWS_PER_BUCKET = 400_000
DIFF_SCHEMA = "snapshot long, source_snapshot long, key_hash long, change_kind string"


def _missing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mask of the items of sorted ``left`` that sorted ``right`` lacks."""
    if not len(right):
        return np.ones(len(left), dtype=bool)
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return right[at] != left


def diff_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Differences within one bucket; columns snapshot, before, after, key_hash, row_hash."""
    out: list[tuple] = []
    order = np.lexsort((rows["key_hash"].to_numpy(), rows["snapshot"].to_numpy()))
    rows = rows.iloc[order]
    snapshot, key, row = (rows[c].to_numpy() for c in ("snapshot", "key_hash", "row_hash"))
    ids, starts = np.unique(snapshot, return_index=True)
    ends = np.append(starts[1:], len(rows))
    place = {s: (a, b) for s, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist())}
    before, after = rows["before"].to_numpy(), rows["after"].to_numpy()
    none = (0, 0)
    for s, (a, b) in place.items():
        prev, nxt = before[a], after[a]
        mine = key[a:b]
        if prev >= 0:
            pa, pb = place.get(int(prev), none)
            old = key[pa:pb]
            new = _missing(mine, old)
            out.append((np.full(new.sum(), s), np.full(new.sum(), s), mine[new], "added"))
            both = ~new
            if both.any():
                at = pa + np.searchsorted(old, mine[both])
                changed = row[at] != row[a:b][both]
                hit = mine[both][changed]
                out.append((np.full(len(hit), s), np.full(len(hit), s), hit, "changed"))
        if nxt >= 0:
            na, nb = place.get(int(nxt), none)
            gone = mine[_missing(mine, key[na:nb])]
            out.append((np.full(len(gone), nxt), np.full(len(gone), s), gone, "removed"))
    frames = [
        pd.DataFrame({"snapshot": a, "source_snapshot": b, "key_hash": k, "change_kind": kind})
        for a, b, k, kind in out
        if len(k)
    ]
    if not frames:
        return pd.DataFrame({"snapshot": [], "source_snapshot": [], "key_hash": [], "change_kind": []}).astype(
            {"snapshot": "int64", "source_snapshot": "int64", "key_hash": "int64", "change_kind": "object"}
        )
    return pd.concat(frames, ignore_index=True)


def _diff_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if rows:
        yield diff_bucket(pd.concat(rows, ignore_index=True))


def snapshot_changes(
    rows: DataFrame, snapshots: DataFrame, *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Changes between consecutive snapshots.

    ``rows``: snapshot long, series string, key string, row_value string,
    order_by timestamp. ``snapshots``: snapshot long, series string, all of
    them, empty ones included, compared in order of ``snapshot`` within a series.
    Returns snapshot, key, change_kind.
    """
    line = Window.partitionBy("series").orderBy("snapshot")
    chain = snapshots.select(
        F.col("snapshot").cast("long").alias("snapshot"),
        "series",
        F.coalesce(F.lag("snapshot").over(line), F.lit(-1)).cast("long").alias("before"),
        F.coalesce(F.lead("snapshot").over(line), F.lit(-1)).cast("long").alias("after"),
    ).drop("series")
    latest = (
        rows.where(F.col("key").isNotNull())
        .select(
            F.col("snapshot").cast("long").alias("snapshot"),
            "key",
            F.struct("order_by", F.coalesce("row_value", F.lit("")).alias("row_value")).alias("version"),
        )
        .join(chain, "snapshot")
        .groupBy("snapshot", "before", "after", "key")
        .agg(F.max("version").alias("version"))
        .select(
            "snapshot",
            "before",
            "after",
            "key",
            F.xxhash64("key").alias("key_hash"),
            F.xxhash64("version.row_value").alias("row_hash"),
        )
    )
    latest = cut(latest)
    buckets = max(parallelism(rows.sparkSession), -(-latest.count() // rows_per_bucket))
    differing = (
        latest.select("snapshot", "before", "after", "key_hash", "row_hash")
        .repartition(buckets, "key_hash")
        .mapInPandas(_diff_partition, DIFF_SCHEMA)
    )
    keys = latest.select(F.col("snapshot").alias("source_snapshot"), "key_hash", "key")
    return differing.join(keys, ["source_snapshot", "key_hash"]).select("snapshot", "key", "change_kind").distinct()


def file_changes(files: DataFrame, generations: DataFrame) -> DataFrame:
    """Added, removed and changed files of each repository's complete snapshots."""
    snapshots = generations.where(F.col("state").isin("complete", "active")).select(
        F.col("generation_id").alias("snapshot"), F.col("repository_id").alias("series")
    ).distinct()
    rows = files.select(
        F.col("generation_id").alias("snapshot"),
        canonical_path(F.col("path")).alias("key"),
        canonical_digest(F.col("content_hash"), F.col("text")).alias("row_value"),
        F.col("captured_at").alias("order_by"),
    )
    return snapshot_changes(rows, snapshots).select(
        F.col("snapshot").cast("int").alias("generation_id"), F.col("key").alias("path"), "change_kind"
    )
