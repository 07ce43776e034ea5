"""The telemetry operators on a stream. An extension: the batch summary stays the reference result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def windowed_rates(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and successes by time window and event type; rows later than ``late`` are dropped by the watermark."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") != "error").alias("succeeded"))
        .select(F.col("window.start").alias("start"), "event_type", "calls", "succeeded")
    )


def without_redelivery(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each event once, as far as the watermark reaches back."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what is available and gives back the result as files in ``path``, a folder all executors share.

    Each batch writes the whole result (mode ``complete``) or its own part (``append``) in parallel, a part under its batch
    number, so a batch that is run again writes the same files again. Nothing is gathered on the driver.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)
