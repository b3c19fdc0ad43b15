"""Streams over folders: plant logs to alerts, and documents that are dropped into a folder to the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cleansing, logs

from . import streams


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def log_alerts(lines: DataFrame, late: str = "1 hour", width: str = "1 day", end: str | None = None) -> DataFrame:
    """Alerts by equipment, kind and window of time, once the watermark has closed the window; later lines are dropped. end:
    see streams.under_watermark."""
    found = logs.with_alert_kind(logs.parse_lines(lines))
    # a key that can't be null would change the state's schema once the stream's end, which has none, is read too
    rows = streams.under_watermark(streams.counted(found.withColumn("alert_type", F.nullif("alert_type", F.lit("")))), late, end)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "equipment", "alert_type").agg(F.count("*").alias("n"), F.max(F.when(F.col("level") == "CRITICAL", 1).otherwise(0)).alias("critical"))
    return counts.select(F.col("w.start").cast("date").cast("string").alias("day"), "equipment", "alert_type", "n", logs.severity(F.col("critical")).alias("severity"))


def dropped_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The manifest rows (digest, status) of documents as their files arrive."""
    return cleansing.corpus_manifest(spark.readStream.schema(schema).parquet(folder))
