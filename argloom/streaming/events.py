"""Streams of telemetry events with their batch twins.

A stream is read from a folder of Parquet files; every query runs until all present files are processed (``availableNow``),
so a restart from the same checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

# Severities of event kinds.
SEVERITY = {"error": "error", "purchase": "success"}


def read_events(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stamped(events: DataFrame, run_id: str, phase: str) -> DataFrame:
    return events.withColumn("run_id", F.lit(run_id)).withColumn("phase", F.lit(phase))


def mapped(events: DataFrame) -> DataFrame:
    """Events with a display name and a severity."""
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return events.withColumn("name", F.concat(F.lit("event."), F.lower("event_type"))).withColumn("severity", F.coalesce(F.try_element_at(severity, F.col("event_type")), F.lit("info")))


def running_metrics(events: DataFrame) -> DataFrame:
    """Counts and acceptance by kind; the same plan on a stream (update or complete mode) and on a table."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_accepted"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling event-time windows; on a stream, state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(df: DataFrame, name: str, checkpoint: str) -> None:
    """Processes all present input into an in-memory table of the whole result: for short aggregates."""
    df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all present input's results to Parquet files; the sink's log makes every batch count once."""
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_upserts(df: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Each micro-batch is written to its own folder by batch number, so a batch that is run again replaces itself: exactly-once output by overwriting."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_RING = "user_id long, seq long, event_id long"


def ring_buffer(events: DataFrame, capacity: int = 10_000) -> DataFrame:
    """Numbers each user's events in arrival order and keeps the last ``capacity`` as state; emits ``user_id, seq, event_id`` of new ones."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for frame in frames:
            ids = frame.sort_values(["ts", "event_id"])["event_id"].tolist()
            yield pd.DataFrame({"user_id": key[0], "seq": range(seq + 1, seq + len(ids) + 1), "event_id": ids})
            seq += len(ids)
            kept = (kept + ids)[-capacity:]
        state.update((seq, kept))

    return events.groupBy("user_id").applyInPandasWithState(update, _RING, "seq long, kept array<long>", "append", "NoTimeout")


def replay(numbered: DataFrame, cursor: int, capacity: int = 10_000) -> DataFrame:
    """What a reader with a cursor gets: events after it, or from the oldest retained one if the cursor is too old."""
    w = Window.partitionBy("user_id")
    oldest = F.greatest(F.lit(0), F.max("seq").over(w) - capacity)
    return numbered.withColumn("_from", F.greatest(F.lit(cursor), oldest)).filter("seq > _from").drop("_from")


def working_memory(turns: DataFrame, size: int = 15) -> DataFrame:
    """Bounded memory of distinct words per conversation and episode: a stream-ready keyed fold that resets when the role changes.

    Emits ``conv_id, episode, n_words, dropped`` per update.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        role, episode, words, dropped = state.get if state.exists else (None, 0, [], 0)
        words = list(words)
        for frame in frames:
            for row in frame.sort_values("turn").itertuples():
                if row.role != role:
                    role, episode, words, dropped = row.role, episode + 1, [], 0
                fresh = [w for w in dict.fromkeys((row.text or "").lower().split()) if w not in words]
                dropped += max(0, len(words) + len(fresh) - size)
                words = (words + fresh)[-size:]
            yield pd.DataFrame({"conv_id": [key[0]], "episode": [episode], "n_words": [len(words)], "dropped": [dropped]})
        state.update((role, episode, words, dropped))

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, episode long, n_words long, dropped long", "role string, episode long, words array<string>, dropped long", "append", "NoTimeout")
