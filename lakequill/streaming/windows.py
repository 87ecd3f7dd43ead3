"""Windowed counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new events."""
    return spark.readStream.schema(schema).parquet(folder)


def counts(events: DataFrame, width: str = "1 day", late: str = "1 day", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events and sums of values by window and type; the watermark bounds the state. The same code runs on a batch."""
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp"))
    return stamped.withWatermark("_ts", late).groupBy(F.window("_ts", width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: events with no gap longer than ``gap``."""
    stamped = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("_ts", late).groupBy(F.session_window("_ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
