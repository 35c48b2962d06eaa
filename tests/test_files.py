"""Hashes of large files, counts from footers, heads of CSV files, prefixes of captions and substrates."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gaugeworks.functions import stats
from gaugeworks.operators import geometry, ranges, recordings
from gaugeworks.sources import readers, sinks, suites


def test_hashes_are_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suites, "CHUNK", 1000)
    data = random.Random(1).randbytes(10_500)
    for k, (a, b) in enumerate([(0, 4000), (4000, 4000), (4000, 10_500)]):
        (tmp_path / f"part-{k}").write_bytes(data[a:b])
    (tmp_path / "_SUCCESS").write_text("no part")
    assert suites.file_sha256(spark, str(tmp_path)) == hashlib.sha256(data).hexdigest()
    rows = spark.createDataFrame([("a", [str(tmp_path / "part-0")]), ("b", [f"file://{tmp_path}/part-2", str(tmp_path / "part-0")]), ("c", []), ("d", None)], "name string, paths array<string>")
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in suites.file_hashes(rows).collect()}
    sha = lambda b: (len(b), hashlib.sha256(b).hexdigest())
    assert got == {"a": sha(data[:4000]), "b": sha(data[4000:] + data[:4000]), "c": sha(b""), "d": sha(b"")}


def test_a_suite_of_many_parts_has_one_hash(spark, tmp_path):
    items = spark.range(500).select(F.format_string("i%04d", "id").alias("item_id"), F.lit("A1").alias("axis"))
    envs = spark.range(3).select(F.format_string("e%d", "id").alias("env_id"))
    sinks.write_suite(items.repartition(4), envs, str(tmp_path / "a"))
    text = "".join('{"item_id":"i%04d","axis":"A1"}\n' % k for k in range(500))
    assert suites.file_sha256(spark, str(tmp_path / "a" / "items.jsonl")) == hashlib.sha256(text.encode()).hexdigest()


def test_footers_answer_counts(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") % 7 - 3).alias("x"), F.lit("t").alias("text"))
    sinks.publish(rows.repartition(3), str(tmp_path / "a"))
    sinks.publish(rows.where("id < 0"), str(tmp_path / "b"))
    got = {r["dataset"]: (r["n_items"], r["low"], r["high"]) for r in suites.footer_counts(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, ["id", "x"]).collect()}
    assert got["a"] == (5000, {"id": "0", "x": "-3"}, {"id": "4999", "x": "3"}) and got["b"][0] == 0
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = suites.footer_totals(own.read.parquet(str(tmp_path / "a")), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(x), MAX(x)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    with pytest.raises(AnalysisException):
        sinks.publish(rows, str(tmp_path / "a"))
    sinks.publish(rows.select("text").limit(2), str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    assert readers.inventory_verdict(spark.createDataFrame([("a", 5000, 5000)], "dataset string, n_items long, official long")).count() == 1


def test_heads_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two, three"\n4,5\n')
    (tmp_path / "b.csv").write_text("x,y\n")
    assert suites.csv_head(spark, str(tmp_path / "a.csv")) == (["x", "y"], ["1", "two, three"])
    assert suites.csv_head(spark, str(tmp_path / "b.csv")) == (["x", "y"], None)


@pytest.mark.parametrize("limit", [15, 1_000_000])
def test_caption_prefixes(spark, monkeypatch, limit):
    monkeypatch.setattr(ranges, "RANGE_ROWS", limit)
    rng = random.Random(3)
    said = [(k * 2, "é" * rng.randrange(20) + f"v{k}", rng.randrange(5)) for k in range(60)]
    cutoffs = [-1, -5, 0, 1, 17, 17, 60, 118, 500]
    got = {r["cutoff"]: (r["n_videos"], r["n_segments"], r["n_chars"]) for r in recordings.caption_prefixes(spark.createDataFrame(said, "video_idx int, said string, n int"), spark.createDataFrame([(c,) for c in cutoffs], "cutoff int")).collect()}
    for c in set(cutoffs):
        own = [s for s in said if c == -1 or s[0] <= c]
        assert got[c] == (len(own), sum(s[2] for s in own), len("\n".join(s[1] for s in own)))
    none = recordings.caption_prefixes(spark.createDataFrame([], "video_idx int, said string, n int"), spark.createDataFrame([(-1,), (3,)], "cutoff int")).collect()
    assert sorted(map(tuple, none)) == [(-1, 0, 0, 0), (3, 0, 0, 0)]


def test_substrates(spark):
    rows = spark.createDataFrame([("e", [1.0, 3.0]), ("e", [3.0, 5.0]), ("f", [0.0, 1.0])], "env string, v array<double>")
    mean = {r["env"]: tuple(r)[1:] for r in geometry.memory_state(rows, "env", "v").collect()}
    assert mean == {"e": ([2.0, 4.0], 2, 16), "f": ([0.0, 1.0], 1, 16)}
    none = {r["env"]: tuple(r)[1:] for r in geometry.memory_state(rows, "env", "v", "none").collect()}
    assert none == {"e": (None, 0, 0), "f": (None, 0, 0)}
    with pytest.raises(ValueError, match="substrate"):
        geometry.memory_state(rows, "env", "v", "lact")
    options = [("A", F.array(F.lit(1.0), F.lit(0.0))), ("B", F.array(F.lit(0.0), F.lit(1.0)))]
    asked = rows.limit(1).select(geometry.calibrated_choice(F.col("v"), F.array(F.lit(0.0), F.lit(9.0)), options).alias("b"), geometry.calibrated_choice(F.col("v"), F.lit(None).cast("array<double>"), options).alias("a")).first()
    assert tuple(asked) == ("B", "A")


def test_large_binomial_tests_stay_linear(spark):
    rows = spark.createDataFrame([(k, n) for k, n in [(0, 0), (0, 1), (1, 1), (0, 9), (9, 9), (3, 12), (25_300, 100_000), (24_000, 100_000)]], "k long, n long")
    got = {(r["k"], r["n"]): r["p"] for r in rows.select("k", "n", stats.binomial_two_sided(F.col("k"), F.col("n"), F.lit(0.25)).alias("p")).collect()}
    assert got[0, 0] == 1.0 and got[0, 1] == pytest.approx(1.0) and got[1, 1] == pytest.approx(0.25) and got[3, 12] == pytest.approx(1.0)
    assert got[25_300, 100_000] == pytest.approx(0.0287, abs=2e-4) and got[24_000, 100_000] < 1e-12


def test_text_after_a_value_is_corrupt(spark):
    lines = spark.createDataFrame([('{"a":1}',), ('{"a":1} {"b":2}',), ('{"a":1}]',), ("[1]",), (" ",)], "value string")
    assert tuple(readers.count_corrupt(lines).first()) == (1, 2)
