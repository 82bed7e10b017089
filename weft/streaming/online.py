"""Structured Streaming forms of the history operators: an extension, as nothing here need be a stream.

Each function maps a streaming DataFrame to one; sources and sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ledger(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An append-only ledger of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(folder)


def append_ledger(rows: DataFrame, folder: str) -> None:
    rows.withColumns({"entry_id": F.expr("uuid()"), "written_at": F.current_timestamp()}).write.mode("append").json(folder)


def churn_by_window(changes: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, block, changes): changes of each block per window, final once the watermark has passed."""
    counts = changes.withWatermark("ts", late).groupBy(F.window("ts", window), "block").agg(F.count(F.lit(1)).alias("changes"))
    return counts.select(F.col("window.start").alias("start"), "block", "changes")


def rate_by_window(requests: DataFrame, seconds: int = 60, slide: int = 10, late: str = "1 minute") -> DataFrame:
    """(start, client, requests): requests of each client in sliding windows."""
    counts = requests.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "client").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("window.start").alias("start"), "client", "requests")


def into_table(rows: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends every batch, prepared, to Parquet; a batch that is replayed replaces its own folder."""

    def put(df: DataFrame, batch: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
