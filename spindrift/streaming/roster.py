"""Incremental matching: new roster rows as a stream against the prepared name index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.linkage import roster_keys


def match_stream(spark: SparkSession, folder: str, schema: str, index: DataFrame) -> DataFrame:
    """rid, name, authorid, sci_name, match_type for every new row: a stream-static join with the index's files."""
    stream = spark.readStream.schema(schema).parquet(folder)
    keys = roster_keys(stream)
    found = keys.join(index.where(F.col("kind") == "exact").select("authorid", "sci_name", "nn"), "nn")
    return found.select("rid", "name", "authorid", "sci_name", F.lit("exact").alias("match_type"))


def event_counts(spark: SparkSession, folder: str, schema: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window under a watermark."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
