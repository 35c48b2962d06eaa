"""Readers and writers on files: missing, repeated and malformed input."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators import corpus, planning, recordings, runs, scans
from gaugeworks.sources import readers, sinks, suites
from gaugeworks.streaming import live


def test_a_log_that_is_not_there_is_empty(spark, tmp_path):
    assert tuple(readers.corrupt_lines(spark, str(tmp_path / "none.jsonl")).first()) == (0, 0)
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n7\n')
    assert tuple(readers.corrupt_lines(spark, str(tmp_path / "p.jsonl")).first()) == (1, 1)
    flagged = readers.read_jsonl_flagged(spark, str(tmp_path / "p.jsonl"), "a int").cache()
    assert flagged.where("_corrupt_record is null").count() == 1


def test_annotations_are_one_file_with_unique_keys(spark, tmp_path):
    rows = [{"question_id": 1, "q": "é"}, {"question_id": 2, "q": "b"}]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "all_qa.json").write_text("﻿" + json.dumps(rows), encoding="utf-8")
    got = readers.read_annotations(spark, str(tmp_path), "question_id int, q string")
    assert {tuple(r) for r in got.collect()} == {(1, "é"), (2, "b")}
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "all_qa.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_annotations(spark, str(tmp_path), "question_id int, q string")
    for bad in ([], rows + rows[:1], [{"q": "no id"}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.read_annotations(spark, str(tmp_path / "bad.json"), "question_id int, q string")


def test_vocabulary(spark, tmp_path):
    assert readers.read_noun_vocabulary(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "n.csv").write_text("id,key\n0,board:cutting\n1, Rack\n2,\n3,board:white\n")
    assert {r["noun"] for r in readers.read_noun_vocabulary(spark, str(tmp_path / "n.csv")).collect()} == {"board", "rack"}
    (tmp_path / "m.csv").write_text("id,noun\n0,cup\n")
    assert [r["noun"] for r in readers.read_noun_vocabulary(spark, str(tmp_path / "m.csv")).collect()] == ["cup"]


def test_narrations_keep_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "n.csv").write_text('participant_id,video_id,narration\nP01,P01_1,"put ""cup""\non table"\n')
    assert readers.read_narrations(spark, str(tmp_path / "n.csv")).first()["narration"] == 'put "cup"\non table'
    assert suites.csv_header(spark, str(tmp_path / "n.csv")) == ["participant_id", "video_id", "narration"]


def test_hashes_and_names(spark, tmp_path):
    good = "version,remote_path,md5\n1,a,%s\n2,a,%s\n" % ("0" * 32, "f" * 32)
    (tmp_path / "h.csv").write_text(good)
    assert readers.read_hashes(spark, str(tmp_path / "h.csv")).count() == 2
    for bad in (good + "1,a,%s\n" % ("1" * 32), good + "3,a,%s\n" % ("F" * 32), good + "4,b,\n"):
        (tmp_path / "h.csv").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_hashes(spark, str(tmp_path / "h.csv"))
    (tmp_path / "n.txt").write_text("a # first\n\n# none\nb\n")
    assert {r["name"] for r in readers.read_names(spark, str(tmp_path / "n.txt"), 2).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        readers.read_names(spark, str(tmp_path / "n.txt"), 3)
    (tmp_path / "n.txt").write_text("a\na\n")
    with pytest.raises(ValueError):
        readers.read_names(spark, str(tmp_path / "n.txt"))


def test_writers_do_not_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    sinks.write_jsonl(rows, str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    with pytest.raises(PySparkException):
        sinks.write_jsonl(rows, str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    files = readers.inventory(spark, str(tmp_path / "out"), "part-*").first()
    assert files["n_bytes"] == size and files["n_files"] >= 1


def test_run_folders(spark, tmp_path):
    (tmp_path / "predictions.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        suites.read_run(spark, str(tmp_path))
    (tmp_path / "predictions.jsonl").write_text('{"item_id": "a", "status": "ok"}\n{"item_id": "a", "status": "error"}\n{"item_id": "b", "sta')
    assert [(r["item_id"], r["status"]) for r in suites.read_run(spark, str(tmp_path)).collect()] == [("a", "error")]
    (tmp_path / "j.jsonl").write_text('{"item_id": "a", "value": 0.5}\n{"item_id"\n')
    assert [r["value"] for r in readers.read_judgments(spark, str(tmp_path / "j.jsonl")).collect() if r["item_id"]] == [0.5]


def test_run_store_order(spark):
    store = spark.createDataFrame([("r2", "2"), ("r1", "1")], "run_id string, started_at string")
    assert [r["run_id"] for r in runs.list_runs(store).collect()] == ["r1", "r2"]
    assert runs.find_run(store, "r2").count() == 1 and runs.find_run(store, "r3").isEmpty()
    rows = spark.createDataFrame([("r1", "b", ("m", "1")), ("r1", "a", ("m", "2")), ("r2", "c", ("m", "1")), ("r1", "d", ("n", "1"))], "run_id string, item_id string, judge struct<model: string, prompt_version: string>")
    assert [r["item_id"] for r in runs.rows_of_run(rows, "r1").collect()] == ["a", "b", "d"]
    assert [r["item_id"] for r in runs.rows_of_run(rows, "r1", "m", "1").collect()] == ["b"]


def test_a_filtered_suite_says_so(spark):
    items = spark.createDataFrame([("a", "e1", "A1"), ("b", "e2", "A1"), ("c", "e1", "A3")], "item_id string, env_id string, axis string")
    envs = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "env_id string")
    told = {"name": "s", "suite_sha": "f00"}
    kept, of, label = suites.filtered(items, envs, told, ["A3", "A1"], ["e1"], 1)
    assert [r["item_id"] for r in kept.collect()] == ["a"] and [r["env_id"] for r in of.collect()] == ["e1"]
    assert label == {"name": "s[axes=A1,A3;envs=e1;limit=1]", "suite_sha": "f00+filtered"}
    assert corpus.suite_label("s", "f00") == ("s", "f00") and corpus.suite_label("s", "f00", limit=0) == ("s[limit=0]", "f00+filtered")


def test_sets_with_nulls(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "k int") for rows in ([1, 1, None, 2], [2, 1, None]))
    assert corpus.set_equal(a, b, "k") and not corpus.set_equal(a, b.where("k is not null"), "k")
    assert tuple(corpus.set_difference(a.limit(0), b, "k").first()) == (0, 3, False)


def test_official_files_are_whole(spark):
    plan = spark.createDataFrame([("a",)], "path string")
    for size, sha in ((0, "0" * 64), (5, "0" * 63), (None, "0" * 64), (5, None)):
        with pytest.raises(ValueError):
            recordings.official_files(plan, spark.createDataFrame([("a", size, sha)], "path string, size long, sha256 string"))
    with pytest.raises(ValueError):
        recordings.official_files(plan, spark.createDataFrame([("b", 5, "0" * 64)], "path string, size long, sha256 string"))


def test_header_variants(spark):
    headers = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["a"],), (["a", "b", "b"],)], "header array<string>")
    got = {tuple(r["header"]): (r["n"], r["complete"]) for r in recordings.header_variants(headers, ["a", "b"]).collect()}
    assert got == {("a", "b"): (2, True), ("a",): (1, False), ("a", "b", "b"): (1, False)}


def test_session_windows_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "u"), ("2024-01-01 00:10:00", "u"), ("2024-01-01 02:00:00", "u")], "t string, k string")
    got = live.session_counts(rows.withColumn("t", F.to_timestamp("t")), "t", "k").select("n").collect()
    assert sorted(r["n"] for r in got) == [1, 2]


def test_caption_queries_follow_their_categories(spark):
    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id string")
    got = suites.caption_queries({"when": part("b", "a"), "what": part("z")}).collect()
    assert [(r["category"], r["query_id"]) for r in got] == [("when", "a"), ("when", "b"), ("what", "z")]


def test_frames_of_a_window(spark):
    assert [spark.range(1).select(planning.window_frames(F.lit(0.0), F.lit(s), 2.0)).first()[0] for s in (0.0, 0.6, 3.0)] == [1, 2, 6]


def test_scan_index_counts_later_scans(spark):
    rooms = spark.createDataFrame([("r", [("a",), ("b",)])], "reference string, scans array<struct<reference: string>>")
    assert [tuple(r) for r in scans.scan_index(rooms).collect()] == [("r", "a", 1, 2), ("r", "b", 2, 2)]
    assert "item_id" in schemas.PREDICTIONS
