"""Structured Streaming jobs over the transaction feed."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capledger.operators.transactions import breaches, feed_metrics, score
from capledger.sources.tables import scan_declared


def append_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append to parquet files, exactly once per checkpoint."""
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def breach_monitor(
    feed: DataFrame, path: str, checkpoint: str, available_now: bool = False, breached_at: Column | None = None
) -> StreamingQuery:
    stamp = F.current_timestamp().cast("timestamp_ntz") if breached_at is None else breached_at
    return append_stream(breaches(feed, stamp), path, checkpoint, available_now)


def score_stream(
    model: PipelineModel, feed: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    return append_stream(score(model, feed), path, checkpoint, available_now)


def metrics_stream(
    feed: DataFrame, flagged: Column, flagged_name: str, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Live feed metrics: each batch writes the whole result (one row) with its number into one of two
    folders, so a repeated batch replaces its own row and nothing piles up."""
    metrics = feed_metrics(feed, flagged, flagged_name)

    def publish(batch: DataFrame, number: int) -> None:
        # Two folders in turn: the one before the newest stays readable while the next is written.
        row = batch.withColumn("batch", F.lit(number).cast("long"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={number % 2}")

    writer = metrics.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_metrics(spark: SparkSession, path: str) -> DataFrame:
    written = spark.read.parquet(path)
    newest = written.agg(F.max("batch")).scalar()
    return written.where(F.col("batch") == newest).drop("batch", "slot")


def raw_fallback(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """Newest breach rows of a sink, for when no model can be applied."""
    return scan_declared(spark, path, "breach_events").orderBy(F.desc("breached_at"), F.desc("transaction_id")).limit(limit)
