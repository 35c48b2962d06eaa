"""Structured Streaming over growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .source import growing_log


def prediction_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Lines of a folder of growing JSON-lines files, each read once it is whole; lines that are no predictions are dropped."""
    lines = growing_log(spark, folder)
    return lines.select(F.from_json("value", schema).alias("p")).where("p.item_id is not null").select("p.*")


def snapshot(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(status, n, n_outside): rows by status within the expected items, and those outside them."""
    marked = rows.join(expected.select("item_id").distinct().withColumn("__in", F.lit(True)), "item_id", "left")
    return marked.groupBy("status").agg(F.count_if(F.col("__in")).alias("n"), F.count_if(F.col("__in").isNull()).alias("n_outside"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts in tumbling or sliding windows with a watermark; plain Spark, without a counterpart in evaluation logs."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), kind).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
