"""Incremental ingest, dedupe, trends and audits with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from signalloom.sources import tables


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def ingest_available(stream: DataFrame, target: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append what arrived since the last run and stop; the checkpoint is the resume position."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(target)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], preserve: Sequence[str] = (), buckets: int = tables.BUCKETS) -> StreamingQuery:
    """Merge every micro-batch into a table in key buckets; each rewrites only the buckets it touches.

    A batch replayed after a failure finishes what was cut off and then changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        tables.upsert_buckets(batch.sparkSession, table, batch, keys, preserve, order, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_trend(stream: DataFrame, time_col: str, by: Sequence[str], watermark: str = "7 days") -> DataFrame:
    """Events per Monday week and key, with late data up to the watermark."""
    return _trend(stream, time_col, by, F.window(time_col, "7 days", "7 days", "4 days"), watermark)


def daily_trend(stream: DataFrame, time_col: str, by: Sequence[str], watermark: str = "1 day") -> DataFrame:
    return _trend(stream, time_col, by, F.window(time_col, "1 day"), watermark)


def _trend(stream, time_col, by, window, watermark):
    counted = stream.withWatermark(time_col, watermark).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("event_count"))
    return counted.select(F.col("w.start").alias("bucket_start"), *by, "event_count")


def dedupe_stream(stream: DataFrame, time_col: str, keys: Sequence[str], watermark: str = "7 days") -> DataFrame:
    """First row per source identity within the watermark."""
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(list(keys))


def audit_stream(stream: DataFrame, path: str, checkpoint: str, measures: dict) -> StreamingQuery:
    """One audit row per micro-batch: the given aggregates with the batch number."""

    def audit(batch: DataFrame, batch_id: int) -> None:
        row = batch.agg(*[m.alias(name) for name, m in measures.items()]).withColumn("run_id", F.lit(batch_id).cast("long"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
