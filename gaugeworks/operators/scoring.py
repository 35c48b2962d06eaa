"""Scoring predictions and breaking scores down: one row an item, one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text


def score_predictions(rows: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Item scores of prediction rows (see ``schemas.PREDICTIONS``) and, for open items, of judgements (item_id, judged)."""
    rows = rows.join(judged.select("item_id", "judged"), "item_id", "left") if judged is not None else rows.withColumn("judged", F.lit(None).cast("double"))
    ok, format_ = F.col("status") == "ok", F.col("answer_format")
    reply = F.coalesce("answer", "answer_text")
    choice = ok & format_.isin("mcq", "mcq5")
    letter = F.when(choice, text.choice_letter(reply, text.option_array(F.col("options"))))
    mra = stats.relative_accuracy(text.parse_number(reply), F.when(F.col("gold_answer_numeric").isNull(), F.raise_error(F.lit("a numeric item needs a gold value")).cast("double")).otherwise(F.col("gold_answer_numeric")))
    score = (
        F.when(~ok, F.lit(None).cast("double"))
        .when(choice, F.when(letter == F.upper(F.coalesce("gold_answer", F.lit(""))), 1.0).otherwise(0.0))
        .when(format_ == "numeric", mra)
        .otherwise(F.col("judged"))
    )
    abstention = F.when(format_ == "mcq5", F.lit("E")).otherwise(F.col("abstention_option"))
    unanswerable = (~ok | choice) & F.coalesce("is_unanswerable", F.lit(False))
    return rows.select("item_id", "axis", score.alias("score"), "status", unanswerable.alias("is_unanswerable"), F.coalesce(choice & (letter == abstention), F.lit(False)).alias("abstained"), "cross_session", (ok & (format_ == "open") & F.col("judged").isNull()).alias("needs_judge"))


def counts(include_errors: bool = True) -> list[Column]:
    """The aggregates of a breakdown; pending items only count as pending, null scores as errors."""
    pending = F.coalesce("needs_judge", F.lit(False))
    failed, done = ~pending & F.col("score").isNull(), ~pending & F.col("score").isNotNull()
    return [
        F.count_if(~pending if include_errors else done).alias("n"),
        F.count_if(done & (F.col("score") >= 1.0)).alias("n_correct"),
        F.count_if(done & (F.col("score") < 1.0)).alias("n_incorrect"),
        F.count_if(done & F.col("abstained")).alias("n_abstained"),
        F.count_if(failed).alias("n_error"),
        F.count_if(pending).alias("n_pending_judge"),
        F.coalesce(F.sum(F.when(done, F.col("score"))), F.lit(0.0)).alias("score_sum"),
    ]


def with_interval(groups: DataFrame) -> DataFrame:
    low, high = stats.wilson(F.col("score_sum"), F.col("n"))
    some = F.col("n") > 0
    return groups.withColumns({"mean": F.try_divide("score_sum", "n"), "ci95_low": F.when(some, low), "ci95_high": F.when(some, high)})


def breakdown(scores: DataFrame, by: str | None = None, include_errors: bool = True) -> DataFrame:
    groups = scores.groupBy(by) if by else scores.groupBy()
    return with_interval(groups.agg(*counts(include_errors)))


def breakdown_sets(scores: DataFrame, by: str = "axis", include_errors: bool = True) -> DataFrame:
    """Overall (null axis) and by axis in one pass."""
    return with_interval(scores.groupingSets([[F.col(by)], []], F.col(by)).agg(*counts(include_errors)))
