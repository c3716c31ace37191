"""Structured Streaming counterparts: windowed rates, bounded dedup, continuous ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenframe.plans.storage import scratch_path


def read_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder as a stream, with bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "168 hours", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; events later than ``late`` are dropped with their state."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = events.withWatermark(ts, late).groupBy(span.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "168 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("session_start"), key, "n")


def dedup(rows: DataFrame, key: str, ts: str | None = None, late: str = "24 hours") -> DataFrame:
    """First row of each key: over all time, or, with a time column, within the watermark, whose state stays bounded."""
    return rows.dropDuplicates([key]) if ts is None else rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, handle, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Run ``handle(batch, epoch)`` on what is available; the checkpoint makes a restart go on where it stopped.

    ``handle`` should be idempotent by epoch: a batch can come again after a failure.
    """
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is available and return the result table, which the batches write to the shared folder.

    With ``complete`` every batch is the whole result, and the last one counts; with ``append`` all of them do. A batch that
    comes again after a failure replaces what it wrote.
    """
    path = scratch_path(spark, name)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).queryName(name).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        found = found.where(F.col("epoch") == found.agg(F.max("epoch")).first()[0])
    return found.drop("epoch")
