"""Streaming ingest: files of chunks as they arrive, each chunk once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import CHUNKS, upgraded


def chunk_stream(spark: SparkSession, folder: str, files_a_trigger: int = 64, late: str = "1 day") -> DataFrame:
    """New chunks of JSON files in a folder; ids seen within the watermark come once."""
    rows = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_a_trigger).json(folder)
    return upgraded(rows).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["chunk_id"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Starts a query that appends new chunks to a Parquet table until what is there has been read."""
    return chunk_stream(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
