"""Continuous ingestion: payload files into the content-addressed store, each different payload once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import addressed


def payload_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def first_seen(stream: DataFrame, content: str, time: str, delay: str = "1 day") -> DataFrame:
    """Payloads whose hash hasn't come within ``delay``; older state is dropped by the watermark, so memory is bounded."""
    return addressed(stream.withWatermark(time, delay), content).dropDuplicatesWithinWatermark(["sha256"])


def activity(stream: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Downloads per window and key, final once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"))
