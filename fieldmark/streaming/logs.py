"""The log as a stream: records are kept once for each key while they are late by less than the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.readStream.schema(ddl).json(path)


def first_records(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """One record for each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, at: str, kind: str, late: str = "1 day") -> DataFrame:
    """Counts for each day and kind (a Spark-native extra)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append the stream to a Parquet table, exactly once under the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
