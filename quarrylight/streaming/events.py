"""Structured Streaming over event files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quarrylight.runtime import ensure_checkpoint_dir

LATE = "1 hour"


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    # Watermarks need instants; times without a zone are taken as UTC.
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def distinct_events(stream: DataFrame, key: list[str], time: str = "ts") -> DataFrame:
    """Each key once; state is dropped as the watermark passes."""
    return stream.withWatermark(time, LATE).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, width: str, *keys: str, time: str = "ts") -> DataFrame:
    return stream.withWatermark(time, LATE).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, key: str, time: str = "ts") -> DataFrame:
    return stream.withWatermark(time, LATE).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def job_states(stream: DataFrame, most_retries: int = 3, stale: str = "10 minutes") -> DataFrame:
    """State of each job from its events (job_id, event, ts): pending again after a failure or a stale run.

    Event-time timers return a running job to pending; after ``most_retries``
    failures it has failed.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries = state.get if state.exists else ("pending", 0)
        if state.hasTimedOut:
            status = "pending"
            state.update((status, retries))
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retries": [retries]})
            return
        latest = 0
        for frame in frames:
            for event, ts in frame.sort_values("ts")[["event", "ts"]].itertuples(index=False):
                latest = max(latest, int(ts.timestamp() * 1000))
                if event == "start":
                    status = "running"
                elif event == "succeed":
                    status = "succeeded"
                elif event == "fail":
                    retries += 1
                    status = "failed" if retries >= most_retries else "pending"
        state.update((status, retries))
        if status == "running" and latest:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(pd.Timedelta(stale).total_seconds() * 1000))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retries": [retries]})

    return stream.withWatermark("ts", LATE).groupBy("job_id").applyInPandasWithState(
        fold, "job_id string, status string, retries int", "status string, retries int", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process what is there, batch by batch; a batch that is replayed meets an idempotent sink."""
    folder = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def collect_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run the stream into one parquet folder per batch, overwritten on replay, and read it back."""
    run_to_end(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}"), mode)
    return stream.sparkSession.read.parquet(folder)
