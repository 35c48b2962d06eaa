"""Event logs of runs: protocol order, late answers, failures and frame accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The phases of a session in their order; a row may follow its own phase only where that repeats.
PHASES = ["env_begin", "ingest", "ingest_end", "query", "env_end"]


def order_violations(log: DataFrame, group: str, order: str, phase: Column) -> DataFrame:
    """(group, n_bad): rows whose phase stands before that of the row before them."""
    before = F.lag("__p").over(Window.partitionBy(group).orderBy(order))
    return log.withColumn("__p", phase).withColumn("__b", before).groupBy(group).agg(F.count_if(F.col("__b") > F.col("__p")).alias("n_bad"))


def phase_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PHASES)), kind)


def answer_class(asked: Column, timed_out: Column) -> Column:
    """An answer's standing: to an unknown item orphan, after its timeout late, else on time."""
    return F.when(~asked, "orphan").when(timed_out, "late").otherwise("on_time")


def classify_answers(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Answer rows of a log (keys, type) with ``standing``, by what stands before them for the same key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kind: F.coalesce(F.max((F.col("type") == kind).cast("int")).over(w), F.lit(0)) > 0
    return log.withColumn("standing", answer_class(seen("query"), seen("timeout"))).where(F.col("type") == "answer")


def item_status(outcome: Column, env_failed: Column, crashed: Column) -> Column:
    """ok for an answer; timeouts and protocol faults keep their name; everything unanswered is an error."""
    return (
        F.when(env_failed, "error").when(outcome == "answer", "ok").when(outcome == "timeout", "timeout")
        .when(outcome.isin("protocol_error", "wrong_id", "error"), "malformed").when(crashed | outcome.isNull(), "error").otherwise("error")
    )


def frame_accounting(acks: DataFrame, group: str) -> DataFrame:
    """(group, total_frames, blank): frames of sessions that were not deferred; a deferred total counts when there are none."""
    own = F.coalesce(F.sum(F.when(~F.col("deferred"), F.coalesce("frames", F.lit(0)))), F.lit(0))
    later = F.coalesce(F.max(F.when(F.col("deferred"), F.col("frames"))), F.lit(0))
    return acks.groupBy(group).agg(F.when(own == 0, later).otherwise(own).cast("long").alias("total_frames"), F.count_if(~F.col("deferred") & (F.col("frames") == 0)).alias("blank"))


def latest_row(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The whole last row of each group; ``order`` must be unique within a group."""
    return rows.groupBy(group).agg(F.max_by(F.struct(*(c for c in rows.columns if c != group)), order).alias("r")).select(group, "r.*")


def last_known(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The latest value of each group that is not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(value, order).alias(value))
