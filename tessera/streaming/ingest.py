"""Incremental ingest and windowed figures with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import parse_files
from ..plans.schema import with_columns


def stream_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str, repository: str = "corpus") -> StreamingQuery:
    """Chunks of text files (path, content as JSON lines) that arrive in folder, appended to out; what is there already is done and then it ends.

    A batch that runs twice writes the same rows into its own folder, so a restart repeats none.
    """
    files = spark.readStream.schema("path string, content string").json(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = with_columns(parse_files(batch).withColumn("repository", F.lit(repository)))
        rows.dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, ts: str = "ts", name: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and maximum of a value in windows of event time; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), name).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), name, "n", "mean", "max")
