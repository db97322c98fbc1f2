"""Streams of asset events: idempotent intake, windows with late data, deduplicated jobs, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.pricing import signal_table

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of events as they come."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once: a repeated event_id within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; what comes later than the watermark is left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def job_keys(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """One row per type and window: the key under which a job runs once."""
    keyed = events.withWatermark("ts", late).withColumn("w", F.window("ts", width)).select(F.concat_ws(":", "event_type", F.date_format("w.start", "yyyyMMddHHmm")).alias("job_id"), F.col("w.end").alias("until"), "ts")
    return keyed.dropDuplicatesWithinWatermark(["job_id"])


def signals(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Events as weighted signals. codes: (event_type, code), a small static table."""
    return signal_table(events.join(F.broadcast(codes), "event_type"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what there is, exactly once over restarts, and ends."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def heartbeat_states(beats: DataFrame, stale_after: int = 60) -> DataFrame:
    """(queue_name, status, checked_at) whenever the status of a queue changes: ok with a beat, stale once none has come for `stale_after` seconds.

    beats: queue_name, checked_at, as they come. A timer of each queue fires without a row; a beat that is older than
    the last changes nothing; a stale queue that beats again is ok.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        last, status = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.update((last, "stale"))
            yield pd.DataFrame({"queue_name": [key[0]], "status": ["stale"], "checked_at": [pd.Timestamp(last)]})
            return
        newest = max((frame["checked_at"].max() for frame in frames), default=None)
        newest = None if pd.isna(newest) else newest.to_pydatetime()
        if newest is not None and (last is None or newest > last):
            state.update((newest, "ok"))
            state.setTimeoutDuration(stale_after * 1000)
            if status != "ok":
                yield pd.DataFrame({"queue_name": [key[0]], "status": ["ok"], "checked_at": [pd.Timestamp(newest)]})
        elif status == "ok":
            state.setTimeoutDuration(stale_after * 1000)

    return beats.select("queue_name", "checked_at").groupBy("queue_name").applyInPandasWithState(
        step, "queue_name string, status string, checked_at timestamp", "last timestamp, status string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
