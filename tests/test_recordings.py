"""Recordings: eligibility reasons, captions, traces, identifiers."""

import hashlib
import json

from pyspark.sql import functions as F

from gaugeworks.functions import ids
from gaugeworks.operators import recordings

QA = (
    "question_id long, choices array<string>, correct_option_index int, correct_answer string, choice_types array<string>, is_answerable boolean, video_ids array<string>, "
    "metadata struct<primary_video_id:string,primary_video_start_time:double>, "
    "question_evidence struct<video_id:string,modalities:array<string>,time_spans:array<struct<start_time:double,end_time:double,video_id:string>>>, "
    "answer_evidence struct<evidence_list:array<struct<video_id:string,start_time:double,modalities:array<string>,time_span:struct<start_time:double,end_time:double>>>>"
)
A, B = "Person_1_session_1_a", "Person_1_session_2_b"


def qa(n, video=A, start=1000.0, cutoff=100.0, evidence=None, **k):
    evidence = evidence if evidence is not None else [(A, 1000.0, ["Video"], (1.0, 2.0))]
    base = {
        "question_id": n, "choices": ["w", "x", "y", recordings.UNANSWERABLE_CHOICE], "correct_option_index": 1, "correct_answer": "x", "choice_types": ["d", "correct", "d", "d"], "is_answerable": True, "video_ids": [A],
        "metadata": (video, start), "question_evidence": (video, ["Video"], [(cutoff, cutoff + 1, None)]), "answer_evidence": (evidence,),
    }
    return tuple((base | k).values())


def test_first_reason_wins(spark):
    rows = [
        qa(1), qa(2, is_answerable=False, choices=["w", "x", "y", "z"]), qa(3, is_answerable=False, evidence=[]), qa(4, evidence=[]), qa(5, evidence=[(A, 1000.0, ["Audio"], (1.0, 2.0))]), qa(6, cutoff=5000.0),
        qa(7, evidence=[(A, 1000.0, ["OCR"], (99.0, 101.0))]), qa(8, evidence=[(B, 500.0, ["Video"], (1.0, 2.0))]), qa(9, evidence=[("Person_9_session_9_z", 7.0, ["Video"], (1.0, 2.0)), (A, 1000.0, ["Video"], (99.0, 500.0))]),
        qa(10, evidence=[("Person_9_session_9_z", 8.0, ["Video"], (1.0, 2.0))]), qa(11, correct_option_index=None), qa(12, evidence=[(A, 1000.0, ["Video"], (2.0, 2.0))]),
    ]
    got = {r["question_id"]: r["reason"] for r in recordings.eligibility(spark.createDataFrame(rows, QA)).collect()}
    assert got == {
        1: None, 2: "invalid_source_row", 3: "unanswerable_not_in_visual_pilot", 4: "missing_evidence", 5: "requires_nonvisual_or_unknown_modality", 6: "query_prefix_outside_budget",
        7: "answer_evidence_after_query_boundary", 8: "requires_cross_session_context", 9: "unknown_or_conflicting_recording_time", 10: "unknown_or_conflicting_recording_time", 11: "invalid_source_row", 12: "invalid_source_row",
    }


def test_history(spark):
    rows = [qa(1, evidence=[(B, 500.0, ["Video"], (1.0, 2.0))], video_ids=[B, A]), qa(2, evidence=[(B, 500.0, ["Video"], (1.0, 2.0))]), qa(3, video_ids=["Person_7_session_7_q"])]
    got = {r["question_id"]: (r["reason"], r["recordings"], r["boundary"]) for r in recordings.eligibility(spark.createDataFrame(rows, QA), history=True).collect()}
    assert got[1] == (None, [B, A], 1100.0)
    assert got[2][0] == "evidence_not_in_official_history" and got[3][0] == "history_has_unknown_recording_times"


def test_caption_modes(spark):
    talk = "array<struct<t:string,text:string>>"
    schema = f"video_idx int, video_id string, time_of_week string, segments array<struct<scene_id:string,time_of_day:string,place:string,activity_summary:string,speech:{talk},events:{talk}>>"
    rows = [(0, "v0", "Mon", [("s", "am", "hall", " walks ", [("1", "hi"), ("2", " ")], [("3", "old"), ("4", "new")])]), (1, "v1", None, [("t", None, None, None, None, None)])]
    captions, cutoffs = spark.createDataFrame(rows, schema), spark.createDataFrame([(0,), (-1,), (0,)], "cutoff int")
    text = {m: {r["cutoff"]: r for r in recordings.caption_context(captions, cutoffs, m).collect()} for m in ("summary", "summary_speech", "important")}
    first = "VIDEO 0 id=v0 weekday=Mon\nSCENE s time_of_day=am place=hall\nCAPTION: walks"
    assert text["summary"][0]["context"] == first and text["summary"][0]["n_segments"] == 1
    assert text["summary_speech"][0]["context"] == first + "\nSPEECH 1: hi" and text["important"][0]["context"] == first + "\nEVENT 4: new"
    assert text["summary"][-1]["context"].endswith("VIDEO 1 id=v1 weekday=\nSCENE t time_of_day= place=") and text["summary"][-1]["n_videos"] == 2


def test_identifiers(spark):
    value = json.dumps({"b": [1, 2.5], "a": "é"})
    rows = spark.createDataFrame([(value, A, "P01_101", 429), ("{", "x", "P01_01", None)], "j string, v string, k string, s int")
    got = rows.select(ids.canonical_digest("j").alias("d"), ids.video_path(F.col("v")).alias("p"), ids.is_extension_video(F.col("k")).alias("e"), ids.retryable(F.col("s"), F.lit("ReadTimeout")).alias("r"), ids.scaled(F.lit(1001), F.lit(500), 640, True).alias("z")).collect()
    assert got[0]["d"] == hashlib.sha256('{"a": "é", "b": [1, 2.5]}'.encode()).hexdigest() and got[1]["d"] is None
    assert got[0]["p"] == f"data/video/Person_1/{A}.mp4" and got[1]["p"] is None
    assert [r["e"] for r in got] == [True, False] and all(r["r"] for r in got) and tuple(got[0]["z"]) == (640, 318)


def test_summaries(spark):
    trace = spark.createDataFrame([("generate_done", "note", True, 1.5, 10), ("generate_done", "answer", None, 0.25, 30), ("sample", None, None, None, None)], "event string, phase string, at_token_limit boolean, generate_seconds double, prompt_tokens int")
    trace = trace.withColumns({c: F.lit(0.5) for c in ("encode_seconds", "transfer_seconds", "decode_seconds")})
    r = recordings.trace_summary(trace).first()
    assert (r["completed_generations"], r["notes_at_token_limit"], r["generate_seconds"], r["max_prompt_tokens"], r["encode_seconds"]) == (2, 1, 1.75, 30, 1.0)
    c = spark.createDataFrame([(True, True), (False, True), (False, False)], "passed boolean, required boolean")
    assert tuple(recordings.conformance_summary(c).first()) == (1, 1, 1)
