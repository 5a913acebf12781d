"""Structured Streaming forms of the corpus and monitoring operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text as tx
from tessera.sources import jsonl


def read_texts(spark: SparkSession, folder: str, text_field: str = "text", files_per_trigger: int | None = None) -> DataFrame:
    """Non-empty texts of JSON lines files as they arrive."""
    reader = spark.readStream.option("pathGlobFilter", "*.jsonl")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return jsonl.parse(reader.text(folder).select(F.col("value").alias("raw")), text_field).filter("kind = 'text' and text <> ''").select("text")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards one by one."""
    return spark.readStream.schema("input_ids array<int>, text_preview string").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "shard-*.jsonl").json(folder)


def dedup(stream: DataFrame, text: str = "text", normalization: str = "whitespace", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First rows of each text. With a time column, state is dropped once the watermark passes it; without, it grows with the distinct texts."""
    keyed = stream.withColumn("key", tx.dedup_key(F.col(text), normalization))
    return keyed.dropDuplicates(["key"]) if time is None else keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def append_log(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)


def counts_by_window(stream: DataFrame, time: str, length: str, *by: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), *by).count()


def streaks(stream: DataFrame, key: str, step: str, value: str, delta: float = 0.01, patience: int = 3) -> DataFrame:
    """key, step, streak, warn for each row: rises in a row by more than delta; the last value and the streak are the state.

    Rows of a batch are taken in order of step; later batches must not go back.
    """

    def run(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = state.get if state.exists else (float("nan"), 0)
        rows = pd.concat(list(batches)).sort_values(step)
        found = []
        for s, v in zip(rows[step], rows[value], strict=True):
            streak = streak + 1 if v > last + delta else 0
            last = v
            found.append((at[0], int(s), int(streak), streak >= patience))
        state.update((float(last), int(streak)))
        yield pd.DataFrame(found, columns=["key", "step", "streak", "warn"])

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(run, "key string, step long, streak long, warn boolean", "last double, streak long", "append", GroupStateTimeout.NoTimeout)
