"""Row counts and freshness of Parquet files as they arrive.

The explorer itself is batch only; this is the one place where a folder that keeps growing is watched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def watched(spark: SparkSession, path: str, schema: T.StructType, time_column: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """A streaming frame of rows per event-time window, late rows dropped after the watermark."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col(time_column).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")
