"""Streams: resumable ingest, incremental plans, windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.runtime import scratch_scope


def new_rows(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``; its checkpoint
    remembers what was read, so a restarted run goes on where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``handle`` to each micro-batch and write its rows to batch=<id>: a
    batch that is run again replaces itself, so every row is written once."""

    def write(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            handle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n): counts of tumbling windows; rows later than ``late`` behind
    the newest are dropped. Wall-clock times are read in the session's zone."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")


def sessions(rows: DataFrame, time: str, key: str, gap: str = "3 days", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions of rows that follow one another within ``gap``."""
    if rows.isStreaming:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = rows.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
