"""Suites with checksums, scans, adapters and conformance."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators import runs, scans
from gaugeworks.sources import readers, suites
from tests.test_operators import item


def test_freeze_and_verify(spark, tmp_path):
    lines = [json.dumps(item(item_id=f"i{k}")) for k in range(2)]
    (tmp_path / "i").write_text("\n".join(lines))
    (tmp_path / "e").write_text(json.dumps({"env_id": "e", "dataset": "d", "sessions": [{"session_id": "s1", "order": 0}]}))
    items, envs = spark.read.schema(schemas.ITEMS).json(str(tmp_path / "i")), spark.read.schema(schemas.ENVS).json(str(tmp_path / "e"))
    folder = str(tmp_path / "suite")
    m = suites.freeze(items, envs, folder, "demo")
    assert m["n_items"] == 2 and len(m["suite_sha"]) == 64
    assert suites.load(spark, folder)[0].count() == 2
    assert suites.describe(items).first()["cross_share"] == 0
    part = next((tmp_path / "suite" / "items.jsonl").glob("part-*"))
    part.write_text(part.read_text() + lines[0].replace("i0", "i9") + "\n")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="items_sha256"):
        suites.load(spark, folder)


def test_scans(spark, tmp_path):
    t = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 3.0, 4.0, 0.0, 1]
    data = [
        {"reference": "room0001x", "type": "train", "scans": [{"reference": "r1", "rigid": [{"instance_reference": 1, "transform": t}, {"instance_reference": 9, "transform": t}, {"instance_reference": 2, "transform": [1.0]}], "removed": [2, 8]}]},
        {"reference": "b", "type": "test", "scans": [{"reference": "r2", "rigid": [{"instance_reference": 1}]}]},
    ]
    (tmp_path / "s.json").write_text(json.dumps(data))
    rows = readers.read_scans(spark, str(tmp_path / "s.json"))
    labels = scans.object_labels(spark.createDataFrame([("room0001x", [("1", "Mug"), ("2", "wall"), ("x", "bad")])], "scan string, objects array<struct<id:string,label:string>>"))
    moves = scans.named_moves(readers.scan_moves(rows), labels)
    assert [(r["label"], r["displacement"]) for r in moves.collect()] == [("Mug", 5.0)]
    assert [r["label"] for r in scans.removals(rows, labels).collect()] == ["wall"]
    envs = scans.environments(rows)
    assert [r["reference"] for r in scans.multi_session(envs).collect()] == ["room0001x"]
    s = scans.summary(envs, moves).first()
    assert (s["environments"], s["scans"], s["moves"], s["median_displacement"]) == (2, 4, 1, 5.0)
    relations = spark.createDataFrame([("room0001x", 1, 2, "close by"), ("room0001x", 1, 7, "left")], "scan string, subject int, object int, predicate string")
    assert [r["object_label"] for r in scans.named_relations(relations, labels).collect()] == ["wall"]
    q = moves.select(scans.question(F.col("reference"), F.col("label"), F.lit(1), F.lit(2)).alias("q")).first()["q"]
    assert q == "In room room0001, the mug was moved between scans. Which object was it closest to in scan 1 of the 2 taken afterwards?"


class Echo:
    def on_env_begin(self, env_id):
        self.env, self.seen = env_id, []

    def ingest(self, session):
        if session["session_id"] == "broken":
            raise RuntimeError("no media")
        self.seen.append(session["session_id"])

    def on_ingest_end(self):
        pass

    def answer(self, query):
        if query["question"] == "?":
            raise ValueError("cannot")
        return f"{self.env}:{','.join(self.seen)}"

    def on_env_end(self):
        pass


def test_adapter(spark):
    sessions = spark.createDataFrame([("e", "s2", 1), ("e", "s1", 0), ("f", "broken", 0)], "env_id string, session_id string, order int")
    queries = spark.createDataFrame([("e", "i1", "q"), ("e", "i2", "?"), ("f", "i3", "q")], "env_id string, item_id string, question string")
    import tests.test_runs as here

    got = {r["item_id"]: (r["status"], r["raw"]) for r in runs.run_adapter(here.Echo, sessions, queries).collect()}
    assert got == {"i1": ("ok", "e:s1,s2"), "i2": ("error", "cannot"), "i3": ("error", "no media")}


def test_conformance_and_health(spark):
    log = [(1, "ready", None), (2, "ingest", None), (3, "ingest_ack", None), (4, "query", "a"), (5, "answer", "a"), (6, "answer", "zz")]
    got = {r["check"]: r["passed"] for r in runs.conformance(spark.createDataFrame(log, "seq int, type string, item_id string")).collect()}
    assert got == {"handshake": True, "ingest_acknowledged": True, "echoes_ids": False, "answers_all": False, "ignores_unknown": False}
    cols = "run_id string, item_id string, n_expected int, exit_code int, status string, total_frames long, sessions_without_frames int, revocation_contested boolean, n_records long, memory_bytes long, context_mode string, expected_mode string"
    rows = [("good", "a", 1, 0, "ok", 5, 0, False, 1, 0, "memory", "memory"), ("short", "a", 2, 0, "ok", 5, 0, False, 1, 0, "memory", "memory"), ("empty", "a", 1, 0, "ok", 5, 0, False, 0, 0, "memory", "memory"), ("blind", "a", 1, 0, "ok", 0, 0, False, 0, 0, "blind", "blind")]
    assert {r["run_id"]: r["failed"] for r in runs.run_health(spark.createDataFrame(rows, cols)).collect()} == {"good": False, "short": True, "empty": True, "blind": False}


def test_replies_and_limits(spark):
    r = spark.range(1).select(runs.parse_reply(F.lit("open"), F.lit(" t\n")).alias("o"), runs.parse_reply(F.lit("mcq"), F.lit(None).cast("string")).alias("m"), runs.timed_out(F.lit("query"), F.lit(301.0)).alias("t")).first()
    assert tuple(r["o"]) == (None, "t") and tuple(r["m"]) == ("", None) and r["t"]
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "candidate int, session string")
    assert {x["candidate"] for x in runs.reachable(c, spark.createDataFrame([("a", 1.0)], "session string, size double")).collect()} == {2}
    q = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "category string, query_id int")
    assert [x["query_id"] for x in runs.select_queries(q, "x", 1, 5).collect()] == [2]


def test_session_state_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    schema = "env_id string, seq int, type string"
    got = []
    for n, events in enumerate([[("e", 1, "env_begin"), ("e", 2, "query"), ("f", 1, "env_begin")], [("e", 3, "ingest"), ("f", 2, "ingest"), ("e", 4, "env_end")]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("env_id", "seq", "type"), e, strict=True))) for e in events))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).groupBy("env_id")
        out = stream.transformWithStateInPandas(runs.SessionState(), schema, "Append", "None")
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [("e", 3, "ingest")]
