"""Queries that run as streams over the event files and end when these are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.runtime import ensure_checkpoint_dir, table
from quarrylight.streaming import events


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return events.read_stream(spark, f"{sf_dir}/events.parquet*", schema)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, although the stream is read twice."""
    stream = _stream(spark, sf_dir)
    return events.collect_to_table(events.distinct_events(stream.union(stream), ["event_id"]), _folder(spark)).select("event_id", "user_id", "event_type")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type, complete at the end of the input."""
    out = events.collect_to_table(events.windowed_counts(_stream(spark, sf_dir), "1 day", "event_type"), _folder(spark), "complete")
    # The folder of the last batch holds the whole result.
    last = out.agg(F.max("batch").alias("batch"))
    rows = out.join(F.broadcast(last), "batch", "left_semi")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known state of a job per user, from events taken as starts, failures and successes."""
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "fail").otherwise("succeed")
    stream = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_id"), kind.alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    out = events.collect_to_table(events.job_states(stream), _folder(spark), "update")
    latest = out.groupBy("job_id").agg(F.max_by(F.struct("status", "retries"), "batch").alias("s"))
    return latest.select("job_id", "s.status", "s.retries")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps under six hours, in batch form."""
    rows = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("began"), "n")


QUERIES = {f.__name__: f for f in (streamed_events, streamed_windows, streamed_jobs, event_sessions)}

ORACLE = {
    "streamed_events": "SELECT event_id, user_id, event_type FROM events",
    "streamed_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""",
}
