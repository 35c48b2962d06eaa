"""Logical tables made from the driver's tables, by expressions the SQL oracles repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item scores of run A: labels.quality, halved for some, with errors and pending items."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    d = F.col("doc_id")
    failed = d % 10 == 3
    waits = ~failed & (d % 17 == 1)
    score = F.when(~failed & ~waits, F.col("quality").cast("double") * F.when(d % 19 == 2, 0.5).otherwise(1.0))
    return rows.select(d.alias("item_id"), F.col("lang").alias("axis"), "source", F.when(failed, "error").otherwise("ok").alias("status"), score.alias("score"), (~failed & ~waits & (d % 11 == 5)).alias("abstained"), waits.alias("needs_judge"))


def scores_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item scores of run B: labels.toxic, with missing items and some under another axis."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("doc_id % 7 <> 0")
    return rows.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 23 == 4, "xx").otherwise(F.col("lang")).alias("axis"), F.col("toxic").cast("double").alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn after them."""
    c = read(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'").alias("a"), c.where("role = 'assistant'").alias("b")
    on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)
    return a.join(b, on).select("a.conv_id", "a.turn", F.col("a.text").alias("gold"), F.col("b.text").alias("reply"))


def epoch(column: str):
    """Microseconds since 1970 of a timestamp, as a long."""
    return F.unix_micros(F.col(column).cast("timestamp"))


SCORES_SQL = """scores AS (
    SELECT l.doc_id AS item_id, d.lang AS axis, d.source, CASE WHEN l.doc_id % 10 = 3 THEN 'error' ELSE 'ok' END AS status,
        l.doc_id % 10 <> 3 AND l.doc_id % 17 = 1 AS needs_judge,
        l.doc_id % 10 <> 3 AND l.doc_id % 17 <> 1 AND l.doc_id % 11 = 5 AS abstained,
        CASE WHEN l.doc_id % 10 <> 3 AND l.doc_id % 17 <> 1 THEN CAST(quality AS DOUBLE) * CASE WHEN l.doc_id % 19 = 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS score
    FROM labels l JOIN documents d USING (doc_id))"""
SCORES_B_SQL = """scores_b AS (
    SELECT l.doc_id AS item_id, CASE WHEN l.doc_id % 23 = 4 THEN 'xx' ELSE d.lang END AS axis, CAST(toxic AS DOUBLE) AS score
    FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 7 <> 0)"""
PAIRS_SQL = """pairs AS (
    SELECT a.conv_id, a.turn, a.text AS gold, b.text AS reply FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""
