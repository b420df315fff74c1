"""Streams over the raw tables, and sinks of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its timestamps become ones that watermarks accept."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    own = read.parquet(path) if path.endswith("/") else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return own.withColumn("at", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work through what is there, batch by batch, and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
