"""Operators on small tables: aggregates, joins, merges, planning, readers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.functions.text import UNANSWERABLE_TEXT
from gaugeworks.operators import compare, corpus, events, geometry, mining, planning, report, scoring
from gaugeworks.sources import readers, sinks
from gaugeworks.streaming import live, upserts

SCORE = "item_id string, axis string, score double, status string, is_unanswerable boolean, abstained boolean, cross_session boolean, needs_judge boolean"


def scores(spark, values, axis="x"):
    return spark.createDataFrame([(f"i{i}", axis, v, "ok" if v is not None else "error", False, False, None, False) for i, v in enumerate(values)], SCORE)


def test_errors_in_and_out_of_the_mean(spark):
    s = scores(spark, [1.0, None])
    assert scoring.breakdown(s).first()["mean"] == 0.5
    assert scoring.breakdown(s, include_errors=False).first()["mean"] == 1.0


def test_pending_and_fractions(spark):
    s = scores(spark, [1.0, 0.9]).unionByName(spark.createDataFrame([("p", "x", None, "ok", False, False, None, True)], SCORE))
    r = scoring.breakdown(s).first()
    assert (r["n"], r["n_correct"], r["n_incorrect"], r["n_pending_judge"], r["n_error"]) == (2, 1, 1, 1, 0)
    empty = scoring.breakdown(s.where("false")).first()
    assert (empty["n"], empty["mean"], empty["ci95_low"]) == (0, None, None)


def gain(spark, a, b):
    return compare.paired_gain(scores(spark, a), scores(spark, b)).first()


def test_paired_gain(spark):
    r = gain(spark, [1.0] * 8 + [0.0] * 2, [1.0] * 3 + [0.0] * 7)
    assert r["gain"] == pytest.approx(0.5) and r["significant"] and r["n_paired"] == 10
    assert gain(spark, [1.0], [0.0])["degenerate"]
    assert gain(spark, [1.0, 1.0], [0.0, 0.0])["degenerate"] and not gain(spark, [1.0, 1.0], [0.0, 0.0])["significant"]
    near = gain(spark, [0.1, 0.1, 0.1, 0.3], [0.0, 0.0, 0.0, 0.2])
    assert near["degenerate"]
    assert gain(spark, [1.0, None], [0.0, 1.0])["n_dropped"] == 1
    assert gain(spark, [None], [1.0]) is None


def test_gain_by_axis_uses_each_runs_axis(spark):
    a, b = scores(spark, [1.0, 1.0], "x"), scores(spark, [0.0, 0.0], "y")
    assert compare.paired_gain(a, b).first()["n_paired"] == 2
    assert compare.paired_gain_by_axis(a, b).count() == 0


def test_prediction_log(spark, tmp_path):
    row = lambda item, answer, **k: json.dumps({"item_id": item, "answer": answer, "status": "ok", **k})
    (tmp_path / "p.jsonl").write_text("\n".join([row("a", "A"), "", row("b", "B"), "not json", row("a", "C"), row("c", "D")[:-9]]))
    got = {r["item_id"]: r["answer"] for r in readers.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got["a"] == "C" and got["b"] == "B"
    assert tuple(readers.corrupt_lines(spark, str(tmp_path / "p.jsonl")).first()) == (3, 2)


def item(**k):
    base = {
        "item_id": "i", "env_id": "e", "session_ids": ["s1", "s2"], "axis": "A1", "answer_format": "mcq5", "question": "q", "options": dict(zip("ABCDE", ["a", "b", "c", "d", UNANSWERABLE_TEXT], strict=True)),
        "answer": "A", "evidence": {"session_ids": ["s1"], "spans": [{"session_id": "s1", "start_sec": 0.0, "end_sec": 1.0}]}, "is_unanswerable": False,
    }
    return base | k


def test_item_rules(spark, tmp_path):
    bad = {
        "blank_id": item(axis=" "), "span_order": item(evidence={"session_ids": [], "spans": [{"session_id": "s1", "start_sec": 2.0, "end_sec": 1.0}]}),
        "evidence_session": item(evidence={"session_ids": ["zz"], "spans": []}), "mcq5_options": item(options={"A": "a"}, answer="A"), "mcq5_answer": item(answer="E"),
        "zero_gold": item(answer_format="numeric", options=None, answer_numeric={"value": 0.0, "unit": "m"}), "open_text": item(answer_format="open", options=None, answer_text=" "),
        "certificate_sessions": item(certificate={"n_sessions": 1, "cross_session": True, "scope": "x"}), "mcq_answer": item(answer_format="mcq", options={"A": "a", "B": "b"}, answer="C"),
    }
    (tmp_path / "i.jsonl").write_text("\n".join(json.dumps(v | {"env_id": k} if k != "blank_id" else v | {"env_id": k}) for k, v in {"good": item(), **bad}.items()))
    rows = readers.read_jsonl_strict(spark, str(tmp_path / "i.jsonl"), schemas.ITEMS)
    found = {}
    for r in schemas.violations(rows, "env_id", schemas.item_rules(UNANSWERABLE_TEXT)).collect():
        found.setdefault(r["env_id"], set()).add(r["rule"])
    assert "good" not in found
    assert all(k in found.get(k, ()) for k in bad), found


def test_suite_round_trip_and_orphans(spark, tmp_path):
    items = spark.read.schema(schemas.ITEMS).json(spark.sparkContext.parallelize([json.dumps(item(item_id=f"i{k}")) for k in range(3)]))
    envs = spark.read.schema(schemas.ENVS).json(spark.sparkContext.parallelize([json.dumps({"env_id": "e", "dataset": "d", "sessions": [{"session_id": "s", "order": 0}]})]))
    manifest = sinks.write_suite(items, envs, str(tmp_path / "suite"))
    assert manifest["n_items"] == 3 and manifest["axes"] == {"A1": 3}
    back, _ = readers.read_suite(spark, str(tmp_path / "suite"))
    assert back.count() == 3
    assert schemas.violations(envs, "env_id", schemas.env_rules()).count() == 0
    assert set(corpus.query_projection(items).columns) == {"item_id", "question", "answer_format", "options", "unit"}
    sinks.write_suite(items, envs.withColumn("env_id", F.lit("other")), str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="no known environment"):
        readers.read_suite(spark, str(tmp_path / "broken"))


def test_filter_keeps_order_and_empty_sets(spark):
    items = spark.createDataFrame([(i, "x" if i % 2 else "y", f"e{i % 3}") for i in range(10)], "item_ord int, axis string, env_id string")
    assert corpus.suite_filter(items).count() == 10
    assert [r["item_ord"] for r in corpus.suite_filter(items, axes={"x"}, limit=2).collect()] == [1, 3]
    assert corpus.suite_filter(items, limit=0).count() == 0


def test_merge_keeps_first_start_and_latches(spark):
    old = spark.createDataFrame([("r", "t0", "f0", True)], "run_id string, started_at string, finished_at string, contested boolean")
    new = spark.createDataFrame([("r", "t1", None, False), ("s", "t2", None, False)], old.schema)
    got = {r["run_id"]: r for r in sinks.merge(old, new, ["run_id"], ("started_at",), ("contested",)).collect()}
    assert (got["r"]["started_at"], got["r"]["finished_at"], got["r"]["contested"]) == ("t0", None, True)
    assert got["s"]["started_at"] == "t2"
    both = sinks.append_latest(old.select("run_id", "finished_at"), new.select("run_id", "finished_at"), ["run_id"])
    assert {(r["run_id"], r["finished_at"]) for r in both.collect()} == {("r", None), ("s", None)}
    with pytest.raises(ValueError):
        sinks.reject_orphans(new, old, "run_id")


def test_greedy_cover_stops_at_first_unaffordable(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (4, "d")], "candidate int, session string")
    sizes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 5.0), ("d", 0.0)], "session string, size double")
    got = [r["session"] for r in planning.greedy_cover(pairs, sizes, 2.5, 4.0).orderBy("step").collect()]
    assert got == ["a", "b"]


def test_plan_budget(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["a"]), (4, ["b"])], "ord int, history array<string>")
    chosen, excluded = planning.plan_budget(rows, "ord", 2, 2)
    assert [r["ord"] for r in chosen] == [1, 3] and excluded == {"video_budget": 1, "item_limit": 1}


def test_overlap_counts_a_pair_once(spark):
    spans = spark.createDataFrame([(1, "v", 0.0, 100.0), (2, "v", 5.0, 5.0)], "span_id int, v string, start double, stop double")
    chunks = spark.createDataFrame([(7, "v", 10.0, 95.0), (8, "v", 100.0, 120.0), (9, "w", 0.0, 50.0)], "chunk_id int, v string, start double, stop double")
    got = [tuple(r) for r in planning.overlaps(spans, chunks, "v", 10.0).collect()]
    assert got == [(1, 7, 10.0, 95.0)]


def test_mirror_questions(spark):
    rows = [("e", 0, "s", "a", "b", 3.0), ("e", 1, "s", "b", "a", 2.0), ("e", 2, "s", "a", "c", 1.0), ("e", 3, "s", "wall", "c", 9.0), ("e", 4, "s", "d", "c", 0.5)]
    built = spark.createDataFrame(rows, "env_id string, ord int, scan string, subject string, gold string, displacement double")
    got = {(r["subject"], r["gold"]) for r in mining.mine_environment(built).collect()}
    assert got == {("a", "b"), ("d", "c")}
    questions = built.where("ord < 2")
    assert [tuple(r) for r in mining.reciprocal_pairs(questions).collect()] == [("a", "b")]
    for q in ("The mug was moved.", "In room 3, the mug was moved; where is it?"):
        assert spark.range(1).select(mining.subject_of(F.lit(q))).first()[0] == "mug"


def test_neighbours_and_choice(spark):
    p = spark.createDataFrame([("s", 1, [0.0, 0.0]), ("s", 2, [1.0, 0.0]), ("s", 3, [3.0, 0.0]), ("t", 4, [0.0, 0.0])], "scan string, id int, v array<double>")
    got = {r["id"]: (r["nn"], r["margin"]) for r in geometry.nearest_with_margin(geometry.neighbours(p, "scan", "id", "v"), "id").collect()}
    assert got == {1: (2, 2.0), 2: (1, 1.0), 3: (2, 1.0)}


def test_late_answers(spark):
    log = spark.createDataFrame([("i", 1, "query"), ("i", 2, "answer"), ("j", 1, "query"), ("j", 2, "timeout"), ("j", 3, "answer"), ("k", 1, "answer")], "item string, seq int, type string")
    got = {(r["item"], r["standing"]) for r in events.classify_answers(log, ["item"], "seq").collect()}
    assert got == {("i", "on_time"), ("j", "late"), ("k", "orphan")}


def test_report_notes(spark, tmp_path):
    run = {"env_id": "e", "n_sessions": 1, "n_records": 0, "total_frames": 3, "sessions_without_frames": 1, "revocation_contested": True, "fd_audit_available": True}
    rows = [{"run_id": "r", "item_id": f"i{k}", "axis": "x", "answer_format": "open", "status": "ok", "answer_text": "t", "system": {"system_id": "s", "context_mode": "memory"}, "env_run": run} for k in range(2)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    p = readers.read_predictions(spark, str(tmp_path / "p.jsonl")).withColumn("ord", F.col("item_id"))
    r = report.run_report(p).first()
    assert r["n_pending_judge"] == 2 and r["n_envs"] == 1 and len(r["notes"]) == 4


def test_stream_keeps_last_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda item, status, at: json.dumps({"run_id": "r", "item_id": item, "status": status, "created_at": at})
    table = str(tmp_path / "t")
    for n, lines in enumerate([[row("a", "timeout", "1"), row("b", "ok", "1")], [row("a", "ok", "2"), "{torn"]]):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(lines) + "\n")
        q = upserts.follow(live.prediction_stream(spark, str(tmp_path / "in"), schemas.PREDICTIONS), table, str(tmp_path / "c"))
        q.awaitTermination(60)
    kept = upserts.read(spark, table, ["run_id", "item_id"])
    assert {r["item_id"]: r["status"] for r in kept.collect()} == {"a": "ok", "b": "ok"}
    snap = live.snapshot(kept, spark.createDataFrame([("a",)], "item_id string")).first()
    assert (snap["n"], snap["n_outside"]) == (1, 1)


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 03:00:00", "b")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = live.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.sql("SELECT kind, n FROM w").collect()} == {("a", 2), ("b", 1)}
