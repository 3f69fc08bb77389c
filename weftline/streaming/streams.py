"""Streaming forms: append-only traces, a bounded queue per key, windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    """Files as they come; the number a trigger takes is the admission rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def append_trace(stream: DataFrame, path: str, checkpoint: str):
    """Everything of a stream appended as JSON lines; runs until what is there has been taken."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def bounded_queue(stream: DataFrame, key: str, sequence: str, capacity: int) -> DataFrame:
    """Per key the ``capacity`` newest sequence numbers so far and how many older ones were dropped, after each
    trigger in which the key had rows. State is the queue itself, so it is bounded."""

    def step(k, batches: Iterator[pd.DataFrame], state):
        held, dropped = state.get if state.exists else ([], 0)
        held = list(held)
        for pdf in batches:
            held += pdf[sequence].tolist()
        held.sort()
        dropped += max(0, len(held) - capacity)
        held = held[-capacity:]
        state.update((held, dropped))
        yield pd.DataFrame({key: [k[0]], "oldest": [held[0]], "newest": [held[-1]], "held": [len(held)], "dropped": [dropped]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, oldest long, newest long, held int, dropped long", "held array<long>, dropped long", "update", "NoTimeout")


def fresh(df: DataFrame, version: str, lag: int) -> DataFrame:
    """Rows at most ``lag`` versions behind the newest."""
    return df.crossJoin(F.broadcast(df.agg(F.max(version).alias("_newest")))).where(F.col(version) >= F.col("_newest") - lag).drop("_newest")


def windowed(df: DataFrame, time: str, length: str, late: str | None = None) -> DataFrame:
    """An extension: counts and sums per window and event type; ``late`` sets a stream's watermark."""
    if late is not None:
        df = df.withWatermark(time, late)
    g = df.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, time: str, gap: str) -> DataFrame:
    """An extension: rows per user and session, which a gap ends."""
    g = df.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
