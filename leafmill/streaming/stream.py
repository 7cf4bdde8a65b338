"""Streams of documents and metrics.

A landing folder is read as a stream of files; each micro-batch passes the same stages as a batch run, and what cannot be
processed goes to a table of rejects. State is held by two things only: windows of metrics, and duplicates within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.model import Dataset
from leafmill.plans.build import Pipeline
from leafmill.sources import load


def watch_files(spark: SparkSession, folder: str, max_bytes: int | None = 20 << 20) -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive; larger ones come without content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files if max_bytes is None else files.withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")))


def extract_stream(files: DataFrame, pipeline: Pipeline, out: str, checkpoint: str, max_pages: int | None = 200) -> StreamingQuery:
    """Run ``pipeline`` on each micro-batch; records go to {out}/records, rejects to {out}/rejects, a folder a batch, so a batch that runs again replaces its own."""
    def batch(df: DataFrame, epoch: int) -> None:
        docs = load.ingest(df.where("content is not null"), max_pages=max_pages)
        good = docs.where("error_class is null")
        done = pipeline.run(Dataset(good))
        if done.records is not None:
            done.records.write.mode("overwrite").parquet(f"{out}/records/batch={epoch}")
        late = df.where("content is null").select(F.sha2("path", 256).alias("doc_id"), "path", F.lit("input_too_large").alias("error_class"), F.lit("too many bytes").alias("error"))
        docs.where("error_class is not null").select("doc_id", "path", "error_class", "error").unionByName(late).write.mode("overwrite").parquet(f"{out}/rejects/batch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(docs: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First of rows with an equal key within the watermark."""
    return docs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_metrics(events: DataFrame, time: str, stage: str, latency: str, window: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, stage, n, mean, worst) in event time; the same on a batch."""
    # watermarks want a timestamp with a time zone
    df = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events
    g = df.groupBy(F.window(time, window, slide) if slide else F.window(time, window), F.col(stage).alias("stage"))
    out = g.agg(F.count("*").alias("n"), F.avg(latency).alias("mean"), F.max(latency).alias("worst"))
    return out.select(F.col("window.start").alias("window_start"), "stage", "n", "mean", "worst")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def map_stream(df: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless transforms work on streams as on batches."""
    return transform(df)
