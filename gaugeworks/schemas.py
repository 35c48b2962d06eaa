"""Explicit schemas of the logical tables, and their domain checks as violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed value sets of the corpus.
ANSWER_FORMATS = ["mcq", "mcq5", "open", "numeric"]
STATUSES = ["ok", "error", "timeout", "malformed", "skipped"]
CONTEXT_MODES = ["blind", "memory", "oracle"]
LETTERS = ["A", "B", "C", "D", "E"]

ITEMS = (
    "item_id string, env_id string, session_ids array<string>, axis string, answer_format string, question string, options map<string,string>, "
    "answer string, answer_text string, answer_numeric struct<value:double,unit:string>, aliases array<string>, "
    "evidence struct<session_ids:array<string>,spans:array<struct<session_id:string,start_sec:double,end_sec:double>>,source_rows:array<string>,notes:string>, "
    "certificate struct<n_sessions:int,span_seconds:double,cross_session:boolean,scope:string>, "
    "provenance struct<miner:string,dataset:string,license:string,gt_exactness:string,miner_confidence:double>, "
    "audit struct<status:string,by:string,notes:string>, bias_score double, is_unanswerable boolean, abstention_option string, source_env_id string"
)
ENVS = "env_id string, dataset string, sessions array<struct<session_id:string,order:int,video_path:string,duration_sec:double,asr_path:string,caption_path:string>>"
ENV_RUN = (
    "struct<env_id:string,n_sessions:int,ingest_seconds:double,memory_bytes:bigint,n_records:bigint,total_frames:bigint,sessions_without_frames:int,"
    "enforcement:string,revocation_contested:boolean,open_media_handles:int,fd_audit_available:boolean>"
)
PREDICTIONS = (
    "schema string, run_id string, item_id string, env_id string, axis string, answer_format string, question string, options map<string,string>, "
    "gold_answer string, gold_answer_text string, gold_answer_numeric double, gold_unit string, aliases array<string>, is_unanswerable boolean, "
    "abstention_option string, cross_session boolean, system struct<system_id:string,context_mode:string,system_version:string,commit:string>, "
    f"env_run {ENV_RUN}, status string, answer string, answer_text string, raw string, error string, latency_ms double, usage map<string,bigint>, created_at string"
)
JUDGMENTS = (
    "run_id string, item_id string, system_id string, axis string, judge struct<model:string,prompt_version:string,prompt_sha256:string,temperature:double,seed:bigint,max_tokens:bigint>, "
    "value double, raw_score double, explanation string, judge_raw string, cost_usd double, created_at string"
)
RUNS = "run_id string, system_id string, context_mode string, suite string, suite_sha string, started_at string, finished_at string, revocation_contested boolean, config_json string, notes string"
NARRATIONS = "participant_id string, video_id string, narration_id string, narration string, verb string, noun string, all_nouns string, start_timestamp string"


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*\z")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule a row breaks; an unknown (null) rule counts as kept."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def item_rules(unanswerable_text: str) -> dict[str, Column]:
    letters, texts, fmt = F.map_keys("options"), F.map_values("options"), F.col("answer_format")
    n = F.coalesce(F.size(letters), F.lit(0))
    start = lambda k: F.slice(F.array(*map(F.lit, LETTERS)), 1, k)
    certificate, spans = F.col("certificate"), F.col("evidence.spans")
    flag = F.coalesce(F.col("is_unanswerable"), F.lit(False))
    five, some = fmt == "mcq5", fmt == "mcq"
    unit = lambda c: (c < 0) | (c > 1)
    return {
        "blank_id": reduce(lambda a, b: a | b, [blank(F.col(c)) for c in ("item_id", "env_id", "axis")]),
        "unknown_format": fmt.isNull() | ~fmt.isin(ANSWER_FORMATS),
        "span_order": F.exists(spans, lambda s: (s["start_sec"] < 0) | (s["end_sec"] < s["start_sec"])),
        "span_session": F.exists(spans, lambda s: ~F.array_contains(F.col("session_ids"), s["session_id"])),
        "evidence_session": F.size(F.array_except("evidence.session_ids", "session_ids")) > 0,
        "certificate_sessions": certificate["cross_session"] & (certificate["n_sessions"] < 2),
        "certificate_scope": (certificate["scope"] == "cross_session") & ~certificate["cross_session"],
        "confidence_range": unit(F.col("provenance.miner_confidence")) | unit(F.col("bias_score")),
        "zero_gold": F.col("answer_numeric.value") == 0.0,
        "mcq5_options": five & ~F.coalesce(letters == F.array(*map(F.lit, LETTERS)), F.lit(False)),
        "mcq5_text": five & (F.try_element_at(F.col("options"), F.lit("E")) != unanswerable_text),
        "mcq5_answer": five & (F.col("answer").isNull() | ~F.col("answer").isin(LETTERS) | (flag != (F.col("answer") == "E"))),
        "mcq_options": some & ((n < 2) | (n > 5) | (letters != start(n)) | F.exists(texts, blank)),
        "mcq_answer": some & (F.col("answer").isNull() | ~F.array_contains(letters, F.col("answer"))),
        "mcq_abstention": some & F.col("abstention_option").isNotNull() & ~F.array_contains(letters, F.col("abstention_option")),
        "mcq_unanswerable": some & (flag != F.coalesce(F.col("answer") == F.col("abstention_option"), F.lit(False))),
        "open_text": (fmt == "open") & (blank(F.col("answer_text")) | (n > 0)),
        "numeric_value": (fmt == "numeric") & (F.col("answer_numeric").isNull() | (n > 0)),
    }


def env_rules() -> dict[str, Column]:
    s = F.col("sessions")
    ids, orders = F.transform(s, lambda x: x["session_id"]), F.array_sort(F.transform(s, lambda x: x["order"]))
    wanted = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
    return {
        "blank_id": blank(F.col("env_id")),
        "no_session": F.coalesce(F.size(s), F.lit(0)) < 1,
        "repeated_session": F.size(F.array_distinct(ids)) < F.size(ids),
        "order_permutation": orders != wanted,
    }
