"""Run summaries, reports in file order, percentiles from counts."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import cli
from gaugeworks.operators import mining, report


def predictions(spark, rows):
    run = "env_run struct<ingest_seconds: double, total_frames: long, memory_bytes: long, revocation_contested: boolean, sessions_without_frames: long, enforcement: string>"
    return spark.createDataFrame([(i, e, s, a, r, ms, (1.5, f, 10 * f, f == 9, 0, "fd"), k) for k, (i, e, s, a, r, ms, f) in enumerate(rows)], f"item_id string, env_id string, status string, answer string, reply string, latency_ms double, {run}, ord int")


def test_run_summary(spark):
    rows = [("a", "x", "ok", "A", "again " * 30, 10.0, 5), ("b", "x", "ok", "A", "I cannot see this.", 30.0, 7), ("c", "y", "error", None, "again " * 30, 99.0, 9), ("d", "y", "ok", "B", "fine", None, 2)]
    p, plan = predictions(spark, rows), spark.createDataFrame([(x,) for x in "abcd"], "item_id string")
    r = report.run_summary(p, plan).first()
    assert (r["n_items"], r["n_output"], r["repeated"], r["refusal"], r["answers"], r["p50_ms"], r["p95_ms"]) == (4, 3, 1, 1, {"A": 2, "B": 1}, 20.0, 29.0)
    assert (r["n_envs"], r["ingest_seconds"], r["frames"], r["max_memory_bytes"], r["contested"], r["enforcement"], r["sessions_without_frames"]) == (2, 3.0, 9, 70, False, ["fd"], 0)
    for bad, of in ((predictions(spark, rows + rows[:1]), plan), (p.where("item_id <> 'a'"), plan), (p, plan.where("item_id <> 'a'")), (p.limit(0), plan)):
        with pytest.raises(ValueError):
            report.run_summary(bad, of)


def test_report_follows_the_file_and_leaves_errors_out(spark, tmp_path):
    rows = [
        {"run_id": f"run-{i}", "item_id": i, "axis": "A1", "answer_format": "mcq", "options": {"A": "x", "B": "y"}, "gold_answer": "A", "status": s, "answer": a, "system": {"system_id": f"of-{i}", "context_mode": "memory"}, "env_run": {"env_id": "e", "n_records": n, "total_frames": 1}}
        for i, s, a, n in (("z", "ok", "A", 0), ("m", "error", None, 3), ("a", "ok", "A", 5))
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    _, (whole, axis) = cli.run(spark, ["report", str(tmp_path / "p.jsonl")])
    assert (whole["run_id"], whole["system_id"], whole["n"], axis["n"]) == ("run-z", "of-z", 3, 3)
    assert not any("no memory records" in n for n in whole["notes"])  # the last record in the file counts, not the last by name
    _, (whole, axis) = cli.run(spark, ["report", str(tmp_path / "p.jsonl"), "--exclude-errors"])
    assert (whole["n"], axis["n"], whole["mean"]) == (2, 2, 1.0)


def test_percentiles_from_counts(spark):
    values = [5, 1, 1, 9, 7, 7, 7, 2, None]
    got = report.index_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", {"lo": (1, 10), "mid": (1, 2), "hi": (9, 10), "top": (1, 1)}).first()
    ranked = sorted(v for v in values if v is not None)
    assert tuple(got) == (ranked[0], ranked[4], ranked[7], ranked[7])


def test_labels_that_differ_in_case_only_are_one_subject(spark):
    rows = [("e", 0, 1, "Chair", "table", 3.0), ("e", 1, 1, "chair", "lamp", 2.0), ("e", 2, 1, "TABLE", "CHAIR", 1.0)]
    built = spark.createDataFrame(rows, "env_id string, ord int, scan int, subject string, gold string, displacement double")
    got = mining.mine_environment(built).select(F.col("subject"), "gold").collect()
    assert [tuple(r) for r in got] == [("Chair", "table")]
