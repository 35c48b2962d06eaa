"""Paired comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import Z95


def _gain(paired: DataFrame, keys: list[str]) -> DataFrame:
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    d = F.when(both, F.col("a") - F.col("b"))
    out = paired.groupBy(*keys).agg(
        F.count_if(both).alias("n_paired"), F.count_if(~both).alias("n_dropped"),
        F.avg(F.when(both, F.col("a"))).alias("mean_a"), F.avg(F.when(both, F.col("b"))).alias("mean_b"), F.avg(d).alias("gain"),
        F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), (F.max(d) - F.min(d)).alias("spread"),
    )
    margin: Column = Z95 * F.col("sd") / F.sqrt("n_paired")
    degenerate = (F.col("n_paired") == 1) | (F.col("spread") <= 1e-9)
    out = out.where("n_paired > 0").withColumns({"ci95_low": F.col("gain") - margin, "ci95_high": F.col("gain") + margin, "degenerate": degenerate})
    return out.withColumn("significant", ~F.col("degenerate") & ((F.col("ci95_low") > 0) | (F.col("ci95_high") < 0))).drop("sd", "spread")


def paired_gain(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gain of run a over run b on items that both scored; others that either run has count as dropped."""
    paired = a.select("item_id", F.col("score").alias("a")).join(b.select("item_id", F.col("score").alias("b")), "item_id", "full")
    return _gain(paired, [])


def paired_gain_by_axis(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same for each axis; a run's item counts under the axis that run gives it."""
    paired = a.select("item_id", "axis", F.col("score").alias("a")).join(b.select("item_id", "axis", F.col("score").alias("b")), ["item_id", "axis"], "full")
    return _gain(paired, ["axis"])
