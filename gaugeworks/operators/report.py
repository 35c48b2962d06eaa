"""Run reports: header, ingest evidence, notes, health, summaries and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, text
from ..sources.readers import last_wins
from . import ranges, scoring


def ingest_evidence(env_runs: DataFrame, order: str = "ord") -> DataFrame:
    """Sums over the last record of each environment; nulls count as 0."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return last_wins(env_runs, ["env_id"], order).agg(
        F.count("*").alias("n_envs"), *(total(c) for c in ("n_sessions", "n_records", "total_frames", "sessions_without_frames")),
        F.coalesce(F.bool_and("fd_audit_available"), F.lit(False)).alias("fd_audit_available"),
    )


def notes(pending: Column, contested: Column, memory: Column, records: Column, blank: Column) -> Column:
    """The report's warnings, those that apply."""
    return F.array_compact(
        F.array(
            F.when(pending > 0, F.concat(pending.cast("string"), F.lit(" open item(s) await a judge and are left out of the mean"))),
            F.when(contested, F.lit("media were still held after ingest ended; memory results are not trustworthy")),
            F.when(memory & (F.coalesce(records, F.lit(0)) == 0), F.lit("ingest reported no memory records")),
            F.when(memory & (F.coalesce(blank, F.lit(0)) > 0), F.concat(blank.cast("string"), F.lit(" session(s) gave no frames; the memory is incomplete"))),
        )
    )


def assemble(header: DataFrame, scores: DataFrame, env_runs: DataFrame, order: str = "ord", include_errors: bool = True) -> DataFrame:
    """``header`` (one row) beside the overall breakdown of ``scores``, ingest evidence and notes."""
    out = header.crossJoin(scoring.breakdown(scores, include_errors=include_errors)).crossJoin(ingest_evidence(env_runs, order))  # one row each
    return out.withColumn("notes", notes(F.col("n_pending_judge"), F.col("revocation_contested"), F.col("context_mode") == "memory", F.col("n_records"), F.col("sessions_without_frames")))


def run_report(predictions: DataFrame, order: str = "ord", judged: DataFrame | None = None, include_errors: bool = True) -> DataFrame:
    """One row: header of the first prediction, overall breakdown, ingest evidence and notes."""
    first = predictions.orderBy(order).limit(1).select("run_id", F.col("system.system_id").alias("system_id"), F.col("system.context_mode").alias("context_mode"))
    flags = predictions.agg(F.coalesce(F.bool_or("env_run.revocation_contested"), F.lit(False)).alias("revocation_contested"))
    env_runs = predictions.where("env_run is not null").select("env_run.*", order)
    return assemble(first.crossJoin(flags), scoring.score_predictions(predictions, judged), env_runs, order, include_errors)


def run_summary(predictions: DataFrame, expected: DataFrame, order: str = "ord") -> DataFrame:
    """One row over a controlled run's predictions, in which an item may stand only once and none may be missing.

    Repetition, refusals, answers and latencies are those of rows with status ok; ingest is that of the last
    record of each environment.  ``expected`` holds the items (item_id) of the run's plan.  Raises ValueError for a run
    that is empty, replayed or incomplete.
    """
    found = predictions.groupBy("item_id").agg(F.count("*").alias("n")).join(expected.select("item_id").distinct().withColumn("due", F.lit(True)), "item_id", "full")
    told = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("due").isNull()).alias("foreign")).first()
    if not told["rows"]:
        raise ValueError("the run has no predictions")
    if told["repeated"]:
        raise ValueError(f"{told['repeated']} item(s) stand in the run more than once")
    if told["missing"] or told["foreign"]:
        raise ValueError(f"{told['missing']} item(s) of the plan are missing and {told['foreign']} are not in it")
    ok = output_diagnostics(predictions.where("status = 'ok'"), "reply")
    output = ok.agg(
        F.count("*").alias("n_output"), F.count_if("repetitive").alias("repeated"), F.count_if("refusal").alias("refusal"),
    ).crossJoin(ranges.linear_percentiles(ok, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}))
    letters = ok.groupBy("answer").agg(F.count("*").alias("n")).where("answer is not null").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("answer", "n")))).alias("answers"))
    some = lambda c: F.coalesce(c, F.lit(0))
    ingest = last_wins(predictions.where("env_run is not null").select("env_id", "env_run.*", order), ["env_id"], order).agg(
        F.count("*").alias("n_envs"), some(F.sum(some("ingest_seconds"))).alias("ingest_seconds"), some(F.sum(some("total_frames"))).alias("frames"), some(F.max(some("memory_bytes"))).alias("max_memory_bytes"),
        F.coalesce(F.bool_or("revocation_contested"), F.lit(False)).alias("contested"), F.array_sort(F.collect_set("enforcement")).alias("enforcement"), some(F.sum(some("sessions_without_frames"))).alias("sessions_without_frames"),
    )
    n = predictions.agg(F.count("*").alias("n_items"))
    return n.crossJoin(output).crossJoin(letters).crossJoin(ingest)  # one row each


def index_percentiles(rows: DataFrame, value: str, points: dict[str, tuple[int, int]], by: list[str] | None = None, range_rows: int | None = None) -> DataFrame:
    """``sorted[n * num // den]`` of each group for each named (num, den), the last element at most.

    Exact, by counts over ranges of values; nulls are left out.
    """
    found = ranges.order_statistics(rows.where(F.col(value).isNotNull()), value, {name: ranges.index_rank(*point) for name, point in points.items()}, by, range_rows)
    return found.drop("__n")


def shortcut_decomposition(scores: DataFrame) -> DataFrame:
    """How a blind run came by its score: failures, replies without a choice, abstentions and commitments."""
    failed, unparsed = F.col("status") != "ok", (F.col("status") == "ok") & F.col("letter").isNull()
    chose = (F.col("status") == "ok") & F.col("letter").isNotNull()
    return scores.agg(
        F.count_if(failed).alias("n_error"), F.count_if(unparsed).alias("n_unparsed"), F.count_if(chose & F.col("abstained")).alias("n_abstained"),
        F.count_if(chose & ~F.col("abstained")).alias("n_committed"), F.count_if(chose & ~F.col("abstained") & (F.col("letter") == F.col("gold"))).alias("n_right"),
    )


def shortcut_report(scores: DataFrame, chance: float = 0.25) -> DataFrame:
    """The decomposition with the letters chosen, the rate of commitments with its interval and test, and the mean had it guessed.

    ``letters`` counts the letters of rows with status ok; abstentions count ``chance`` each in ``naive_mean``.
    """
    parts = shortcut_decomposition(scores)
    said = scores.where("status = 'ok' and letter is not null").groupBy("letter").agg(F.count("*").alias("n"))
    letters = said.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("letter", "n")))).alias("letters"))  # one entry a letter
    n = F.col("n_error") + F.col("n_unparsed") + F.col("n_abstained") + F.col("n_committed")
    low, high = stats.wilson(F.col("n_right"), F.col("n_committed"))
    some = F.col("n_committed") > 0
    return parts.crossJoin(letters).withColumns({  # one row each
        "mean": F.try_divide("n_right", n), "naive_mean": F.try_divide(F.col("n_right") + F.col("n_abstained") * chance, n), "rate": F.try_divide("n_right", "n_committed"),
        "rate_low": F.when(some, low), "rate_high": F.when(some, high), "p_value": F.when(some, stats.binomial_two_sided(F.col("n_right"), F.col("n_committed"), F.lit(chance))),
    })


def arm_outcomes(probes: DataFrame, template: Column) -> DataFrame:
    """By arm: probes without a control answer (repetitive, in a template or not, refusals), and controls answered exactly.

    ``probes`` has (arm, answer, expected_control); ``template`` marks probes in the wording of training.
    """
    rows = output_diagnostics(probes.withColumn("__template", template), "answer")
    control = F.col("expected_control").isNotNull()
    return rows.groupBy("arm").agg(
        F.count_if(~control).alias("video_probes"), F.count_if(~control & F.col("repetitive")).alias("repeated"), F.count_if(~control & F.col("repetitive") & ~F.col("__template")).alias("free_repeated"),
        F.count_if(~control & F.col("repetitive") & F.col("__template")).alias("template_repeated"), F.count_if(~control & F.col("refusal")).alias("refusal_text"),
        F.count_if(control & (text.strip(F.col("answer")) == F.col("expected_control"))).alias("controls_correct"), F.count_if(control).alias("n_controls"),
    )


def output_diagnostics(rows: DataFrame, reply: str) -> DataFrame:
    """Adds tokens_approx, repeated_fraction, repetitive, refusal and empty."""
    rows = rows.withColumn("__t", text.diagnostic_tokens(F.col(reply)))
    rows = rows.withColumn("__g", text.ngrams(F.col("__t"), 4))
    grams = F.size("__g")
    rows = rows.withColumn("__d", F.size(F.array_distinct("__g"))).withColumn("__s", F.sort_array("__g"))
    # Three equal n-grams in a row of the sorted list: one occurs three times or more.
    thrice = F.exists(F.sequence(F.lit(1), F.greatest(grams - 2, F.lit(1))), lambda i: (grams >= 3) & (F.try_element_at("__s", i) == F.try_element_at("__s", i + 2)))
    ratio = F.when(grams > 0, 1 - F.col("__d") / grams).otherwise(0.0)
    out = rows.withColumns({"tokens_approx": F.size("__t"), "repeated_fraction": ratio, "repetitive": (F.size("__t") >= 20) & (ratio >= 0.4) & thrice})
    return out.withColumns({"refusal": text.refuses(F.col(reply)), "empty": text.strip(F.coalesce(reply, F.lit(""))) == ""}).drop("__t", "__g", "__d", "__s")


def lexical_scores(rows: DataFrame, reply: str, gold: str) -> DataFrame:
    """Adds exact, substring and f1 of normalised words."""
    r, g = text.lexical_words(F.col(reply)), text.lexical_words(F.col(gold))
    rows = rows.withColumn("__r", r).withColumn("__g", g)
    joined_r, joined_g = F.array_join("__r", " "), F.array_join("__g", " ")
    return rows.withColumns({
        "exact": joined_r == joined_g, "substring": (joined_g != "") & joined_r.contains(joined_g), "f1": text.token_f1(F.col("__r"), F.col("__g")),
    }).drop("__r", "__g")


def caption_eval(rows: DataFrame, by: str) -> DataFrame:
    """Counts by category; F1 over rows with status ok only, null without any."""
    ok = F.col("status") == "ok"
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(ok & F.col("exact")).alias("exact"), F.count_if(ok & F.col("substring")).alias("substring"), F.avg(F.when(ok, F.col("f1"))).alias("mean_f1"),
    )


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    return ranges.linear_percentiles(rows, value, {"p50": 0.5, "p95": 0.95}, [by])


def arm_matrix(probes: DataFrame, key: str, arm: str, arms: list[str]) -> DataFrame:
    """(key, n_arms, complete): does every probe have exactly these arms?"""
    seen = F.collect_set(arm)
    return probes.groupBy(key).agg(F.size(seen).cast("long").alias("n_arms"), (F.array_sort(seen) == F.array(*map(F.lit, sorted(arms)))).alias("complete"))


def attempts(trace: DataFrame, group: str, order: str | list[str], starts: Column, range_rows: int | None = None) -> DataFrame:
    """Rows of each group with ``attempt``: how many starts stand at or before the row.

    ``order`` names numbers or times, or one struct of them; a group of any size is spread over ranges of its order.
    """
    kind = trace.schema[order].dataType if isinstance(order, str) else None
    values = order if kind is None else [f"{order}.{f.name}" for f in kind.fields] if isinstance(kind, T.StructType) else [order]
    marked = trace.withColumn("__start", F.coalesce(starts, F.lit(False)).cast("long"))
    return ranges.running_total(marked, [group], values, "__start", "attempt", range_rows).drop("__start")
