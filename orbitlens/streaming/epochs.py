"""Stage events and streamed epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_events(events: DataFrame, key: str = "step", order: str = "seq", value: str = "value") -> DataFrame:
    """Last value of every key, as a client that merges frames in order sees it."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def windowed_counts(spark: SparkSession, folder: str, schema, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """A stream over the Parquet files of a folder: events by type and window, with a watermark that bounds the state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
