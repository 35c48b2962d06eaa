"""Streams: growing logs, upserts by bucket, timers and late answers against their batch forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.streaming import sessions, source, upserts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key)


def drain(df, folder, keep):
    q = df.writeStream.foreachBatch(lambda rows, _: keep.extend(map(tuple, rows.collect()))).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


# Growing logs


def test_pieces_share_lines_without_loss(tmp_path, monkeypatch):
    rng = random.Random(1)
    told = ["".join(rng.choices("abé", k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(400)]
    path = tmp_path / "a.log"
    path.write_bytes("\n".join(told).encode() + b"\n{torn")
    size = os.path.getsize(path)
    for chunk, piece in ((7, 50), (64, 33), (1 << 20, 1000), (5, 1 << 20)):
        monkeypatch.setattr(source, "CHUNK", chunk)
        monkeypatch.setattr(source, "PIECE", piece)
        reader = source.GrowingLogReader(str(tmp_path), ".log")
        end = reader.latestOffset()
        assert end == {str(path): size - 5}
        parts = reader.partitions(reader.initialOffset(), end)
        assert [t for p in parts for _, texts in source.lines(p) for t in texts] == told
        raw = path.read_bytes()
        assert all(raw[a : a + len(t.encode())] == t.encode() for p in parts for at, texts in source.lines(p) for a, t in zip(at, texts, strict=True))


def test_a_torn_line_waits_for_its_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, got = tmp_path / "in" / "run.jsonl", []
    stream = source.growing_log(spark, str(tmp_path / "in"), ".jsonl")
    for part in ('{"a":1}\n{"a":', "2}\r\n", "", '\n{"a":3}\n{"a"', ":4}\n"):
        with log.open("a", newline="") as f:
            f.write(part)
        (tmp_path / "in" / "_other.jsonl").write_text("hidden\n")
        drain(stream, str(tmp_path / "c"), got)
    assert [v for _, _, v in sorted(got)] == ['{"a":1}', '{"a":2}', "", '{"a":3}', '{"a":4}']
    assert [a for _, a, _ in sorted(got)] == [0, 8, 17, 18, 26]
    reader = source.GrowingLogReader(str(tmp_path / "in"), ".jsonl")
    reader.latestOffset()
    log.write_text("x\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()


# Upserts by bucket


def written(table, epoch):
    return sum(f.stat().st_size for kind in ("added", "merged") for f in (table / kind / f"epoch={epoch}").rglob("*.parquet")) if table.exists() else 0


def test_upserts_keep_the_newest_and_write_by_the_batch(spark, tmp_path):
    rng, table, newest = random.Random(2), tmp_path / "t", {}
    big = [("r", f"i{k}", "first", f"{k:06}") for k in range(4000)]
    batches = [big] + [[("r", f"i{rng.randrange(5000)}", f"v{e}", f"{k:06}") for k in range(30)] for e in range(1, 6)]
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, item_id string, status string, created_at string")
    for e, rows in enumerate(batches):
        for _ in range(2 if e in (0, 3) else 1):  # run again, as after a lost commit
            upserts.upsert(frame(rows), e, str(table), ["run_id", "item_id"], "created_at", buckets=8)
        newest |= {r[1]: r for r in sorted(rows, key=lambda r: r[3])}
        assert {r["item_id"]: tuple(r) for r in upserts.read(spark, str(table), ["run_id", "item_id"]).collect()} == newest
    runs = upserts._index(spark, str(table))
    assert set(runs) == set(range(8)) and all(a[1] > 2 * b[1] for own in runs.values() for a, b in zip(own, own[1:]))
    assert max(written(table, e) for e in range(1, 6)) < written(table, 0)
    assert all(folder.startswith(("added/epoch=0", "merged/", "added/")) for own in runs.values() for folder, _ in own)
    rows_written = lambda e: sum(spark.read.parquet(str(table / kind / f"epoch={e}")).count() for kind in ("added", "merged") if (table / kind / f"epoch={e}").exists())
    assert max(rows_written(e) for e in range(1, 6)) <= 30 * 6
    with pytest.raises(ValueError, match="no finished batch"):
        upserts.read(spark, str(tmp_path / "none"), ["item_id"])


# Timers


def test_streamed_timeouts_equal_the_batch_form(spark, tmp_path, state_store):
    at = lambda s: f"2024-01-01 {s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"
    log = [
        ("slow", 1, 0, "env_begin"), ("slow", 2, 700, "ready"), ("good", 1, 0, "env_begin"), ("good", 2, 5, "ready"), ("good", 3, 10, "ingest"), ("good", 4, 3600, "ingest_ack"),
        ("good", 5, 3610, "query"), ("good", 6, 3700, "ready"), ("good", 7, 3800, "answer"), ("good", 8, 3900, "query"), ("mute", 1, 20, "env_begin"), ("mute", 2, 30, "ready"), ("mute", 3, 40, "ingest"),
        ("good", 9, 4000, "env_end"), ("next", 1, 4100, "query"), ("next", 2, 4300, "query"), ("next", 3, 4700, "answer"), ("edge", 1, 4000, "query"), ("edge", 2, 4300, "answer"), ("last", 1, 9000, "query"),
    ]
    log.sort(key=lambda r: (r[2], r[1]))  # as a harness writes it
    rows = spark.createDataFrame([(e, n, at(s), k) for e, n, s, k in log], "env_id string, seq long, at string, type string").withColumn("at", F.to_timestamp("at"))
    want = {tuple(r) for r in sessions.phase_timeouts(rows).collect()}
    assert {(r[0], r[1], r[2]) for r in want} == {("slow", 1, "ready"), ("mute", 3, "ingest_ack"), ("next", 2, "answer")}
    got, folder = [], tmp_path / "in"
    for n, (a, b) in enumerate([(0, 3), (3, 9), (9, 14), (14, 19), (19, 20)]):
        part = rows.where(F.concat_ws(":", "env_id", "seq").isin([f"{e}:{k}" for e, k, *_ in log[a:b]]))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        drain(sessions.stream_timeouts(spark.readStream.schema(rows.schema).parquet(str(folder))), str(tmp_path / "c"), got)
    assert sorted(got) == sorted(want), n


# Late answers


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_streamed_standing_equals_the_query(spark, tmp_path):
    want = {r["class"]: r["n"] for r in plans.QUERIES["late_answer_classification"](spark, SMALL).collect()}
    kind = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "answer").otherwise("other")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    log = events.select("user_id", (F.col("event_id") % 20).alias("item"), F.col("event_id").alias("id"), F.timestamp_seconds("event_id").alias("at"), kind.alias("type"))
    last = events.agg(F.max("event_id")).first()[0]
    blank = lambda at: spark.createDataFrame([(-1, 0, -1, at, "other")], "user_id long, item long, id long, at long, type string").withColumn("at", F.timestamp_seconds("at"))
    got, folder = [], tmp_path / "in"
    for part in (log.where(f"id < {last // 2}"), log.where(f"id >= {last // 2}"), blank(9 * last), blank(19 * last), blank(29 * last)):
        part.coalesce(1).select(*(F.col(f.name).cast(f.dataType) for f in log.schema.fields)).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(log.schema).parquet(str(folder))
        stream = stream.unionByName(stream.where("id % 3 = 0"))  # told twice
        drain(sessions.late_answers(stream, ["user_id", "item"], f"{last + 1} SECONDS"), str(tmp_path / "c"), got)
    assert len({r[2] for r in got}) == len(got)
    assert {c: sum(r[4] == c for r in got) for c in want} == want


def test_predictions_of_a_growing_log(spark, tmp_path):
    from gaugeworks import schemas
    from gaugeworks.streaming import live

    (tmp_path / "in").mkdir()
    a, b = ('{"run_id": "r", "item_id": "a", "status": "s%d", "created_at": "%d"}\n' % (n, n) for n in range(2))
    for part in (a + '{"run_id": "r", "item_id": "b"', ', "status": "late"}\n' + b):
        with (tmp_path / "in" / "p.jsonl").open("a") as f:
            f.write(part)
        q = upserts.follow(live.prediction_stream(spark, str(tmp_path / "in"), schemas.PREDICTIONS), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert {r["item_id"]: r["status"] for r in upserts.read(spark, str(tmp_path / "t"), ["run_id", "item_id"]).collect()} == {"a": "s1", "b": "late"}
