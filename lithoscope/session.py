"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC timestamps written as 64-bit microseconds; nanosecond columns are carried as numbers.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that the caller made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
