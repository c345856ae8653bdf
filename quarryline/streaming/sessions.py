"""Structured Streaming forms: evidence per watermark window, and a navigation stack per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files with a UTC event time."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped, as Spark defines."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stack = list(state.get[0]) if state.exists else ["root"]
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for kind, k in zip(rows["event_type"], rows["k"], strict=True):
        if kind == "view":
            stack.append(str(k))
        elif kind == "click" and len(stack) > 1:
            stack[-1] = str(k)
        elif kind == "error" and len(stack) > 1:
            stack.pop()
    state.update((stack,))
    yield pd.DataFrame({"user_id": [key[0]], "depth": [len(stack)], "top": [stack[-1]]})


def navigation(events: DataFrame) -> DataFrame:
    """I14 as a stream: after each batch, every touched session's depth and top; the root never pops."""
    keyed = events.select("user_id", "event_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    return keyed.groupBy("user_id").applyInPandasWithState(_walk, "user_id long, depth long, top string", "stack array<string>", "update", GroupStateTimeout.NoTimeout)
