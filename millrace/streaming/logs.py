"""Incremental runs over append-only logs, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def append_log(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Work on all that is there and append it batch by batch, then end.

    A batch that was interrupted runs again under its own number and replaces what
    it had written, so nothing is lost and nothing is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, key: str, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come before. With an event time, keys are forgotten once rows would be too late; otherwise the state has every key."""
    if event_time:
        return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the output doesn't have; those that ran without result run again."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` replaces rows of `old` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def running_counts(rows: DataFrame, key: str) -> DataFrame:
    """Counts by key, to be written in complete or update mode."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))
