"""Streaming forms of order-dependent measures over event files: windowed counts with a watermark, and repeats of a user's last event
kept as state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "user_id long, events long, repeats long"


def stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    kind = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def repeats(events: DataFrame) -> DataFrame:
    """Events and immediate repeats of each user so far, with the last event as state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, same, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            n, same, last = n + 1, same + (kind == last), kind
        state.update((n, same, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "repeats": [same]})

    return events.groupBy("user_id").applyInPandasWithState(step, STATE, "n long, same long, last string", "update", "NoTimeout")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the streaming engine, as a table in memory."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
