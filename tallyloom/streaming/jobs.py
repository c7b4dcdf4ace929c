"""Streams: documents as they arrive, and the task board by the hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_board(tasks: DataFrame, late: str = "1 day") -> DataFrame:
    """hour, status and n of a stream (or table) of tasks with created_at; rows later than the watermark are dropped."""
    hour = F.window("created_at", "1 hour")
    return tasks.withWatermark("created_at", late).groupBy(hour.alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def ingest_arrivals(arrivals: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Run a job over each document once and append its rows below target, a folder for each batch.

    A document that comes again within the watermark is dropped. A batch that is run again after a
    failure overwrites its own folder, so results hold every document once.
    """
    once = arrivals.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
