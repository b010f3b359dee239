"""Streams of points: the stateless operators as they are, and counts by class under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial_join import contain_join


def points(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def contained(stream: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Each point of the stream with the polygon that holds it (J01): a stream joined with a broadcast table."""
    return contain_join(stream, polygons, broadcast=True, **options)


def class_counts(stream: DataFrame, key: Column, time: str, window: str, lateness: str) -> DataFrame:
    """start, class, n: features by class and time window; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, lateness).withColumn("class", key.cast("string")).filter(F.col("class").isNotNull())
    by = rows.groupBy(F.window(time, window).alias("w"), "class").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), "class", "n")
