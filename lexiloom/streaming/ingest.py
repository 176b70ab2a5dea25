"""Streaming ingestion of document packages: an extension of the batch gate.

Files are validated as they arrive.  Each micro-batch is written under its own
batch id, so a batch that runs again after a failure replaces its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.packages import validate

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """file, content, modificationTime of new files; equal contents within a day count once."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_batch).load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "modificationTime", F.sha2("content", 256).alias("content_hash"))
    return named.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["content_hash"])


def validate_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of each micro-batch to target/batch=<id>, partitioned by status."""

    def one(batch: DataFrame, batch_id: int) -> None:
        validate(batch.select("file", "content")).write.mode("overwrite").partitionBy("status").json(f"{target}/batch={batch_id}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """window_start, by, n, total of events (value): works on a stream and on a table alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    made = marked.groupBy(F.window(time, width), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("window_start"), *(by or []), "n", "total")
