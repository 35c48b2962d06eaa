"""Ranges of groups that are larger than a task should hold, against plain sorting."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import planning, ranges, report, scans


@pytest.fixture(params=[20, 1_000_000])
def limit(request, monkeypatch):
    """Small ranges, so that groups are cut in several rounds, and the production limit, so that none is."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", request.param)
    return request.param


def groups(seed=1):
    rng = random.Random(seed)
    return {
        "even": [float(i) for i in range(700)], "heavy": [rng.paretovariate(0.3) for _ in range(900)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.0, -7.5]) for _ in range(500)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(600)], "one": [3.0], "two": [3.0, 4.0], "same": [5.0] * 200, "": [rng.gauss(0, 1) for _ in range(300)],
    }


def frame(spark, told):
    rows = [(k or None, v) for k, vs in told.items() for v in vs] + [("none", None), ("one", None)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double")


def test_order_statistics_equal_sorted_lists(spark, limit):
    told = groups()
    points = {"p10": (1, 10), "p50": (1, 2), "p90": (9, 10), "pmax": (1, 1)}
    got = {r["g"] or "": r for r in report.index_percentiles(frame(spark, told), "v", points, ["g"]).collect()}
    assert set(got) == set(told)
    for k, vs in told.items():
        at = sorted(vs)
        assert [got[k][p] for p in points] == [at[min(len(at) * n // d, len(at) - 1)] for n, d in points.values()], k
    whole = sorted(v for vs in told.values() for v in vs)
    assert tuple(report.index_percentiles(frame(spark, told), "v", {"m": (1, 2), "top": (1, 1)}).first()) == (whole[len(whole) // 2], whole[-1])
    assert tuple(report.index_percentiles(frame(spark, {}), "v", {"m": (1, 2)}).first()) == (None,)


def test_linear_percentiles_equal_the_built_in(spark, limit):
    rows = frame(spark, groups(3))
    got = {r["g"]: (r["p50"], r["p95"]) for r in report.latency_percentiles(rows, "g", "v").collect()}
    want = {r["g"]: (r["a"], r["b"]) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b")).collect()}
    assert set(got) == set(want) and got["none"] == (None, None)
    for k in set(want) - {"none"}:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_running_totals(spark, limit):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([1, 2, 2, 2, 2, 3, rng.randrange(900)]), k, rng.randrange(-3, 9)) for k in range(1500)]
    out = ranges.running_total(spark.createDataFrame(rows, "g string, t int, k int, x int"), ["g"], ["t", "k"], "x", "upto").collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["g", "t", "k", "x", "upto"]
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: (r["t"], r["k"])):
            total += r["x"]
            assert r["upto"] == total


def test_ranges_are_small_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 25)
    rows, cut = ranges.ranged(frame(spark, groups(5)).where("g <> 'same'"), ["g"], ["v"])
    told = rows.groupBy("g", ranges.RANGE).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    assert cut and all(r["n"] <= 25 or r["low"] == r["high"] for r in told)
    for g in {r["g"] for r in told}:
        own = sorted((r for r in told if r["g"] == g and r["low"] is not None), key=lambda r: r[ranges.RANGE])
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:]))


def test_asof_over_a_hot_recording(spark, limit):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randrange(4000), f"f{k:04}" if k % 40 else None) for k in range(1200)] + [("blank", 5, None)]
    asked = [(g, rng.randrange(-50, 4200)) for g in ["hot"] * 150 + ["b", None, "gone", "blank"] * 20] + [("hot", 77)] * 3
    out = planning.asof_forward(spark.createDataFrame(asked, "g string, target long"), spark.createDataFrame(rows, "g string, t int, f string"), "g", "t", "f").collect()

    def plain(g, target):
        own = sorted((t, f) for h, t, f in rows if h == g and f is not None)
        return next((f for t, f in own if t >= target), own[-1][1] if own else None)

    told = sorted(((r["g"] or "", r["target"], r["f"] or "") for r in out))
    assert told == sorted((g or "", t, plain(g, t) or "") for g, t in asked)


def test_attempts_visible_counts_and_medians(spark, limit):
    rng = random.Random(7)
    trace = [("hot" if k % 7 else None, k // 3, k, rng.random() < 0.1) for k in range(900)]
    rows = spark.createDataFrame(trace, "env string, ts int, seq int, begins boolean").withColumn("at", F.struct("ts", "seq"))
    got = {r["seq"]: r["attempt"] for r in report.attempts(rows, "env", "at", F.col("begins")).collect()}
    count = {"hot": 0, None: 0}
    for env, _, seq, begins in trace:
        count[env] += begins
        assert got[seq] == count[env]
    asked = spark.createDataFrame([(k, -1 if k % 9 == 0 else k * 5) for k in range(80)], "id int, cutoff int")
    values = [rng.randrange(300) for _ in range(700)]
    seen = planning.visible_counts(asked, spark.createDataFrame([(v,) for v in values], "v int"), "cutoff", "v", "id").collect()
    assert {r["id"]: r["n_visible"] for r in seen} == {k: 700 if k % 9 == 0 else sum(v <= k * 5 for v in values) for k in range(80)}
    moves = spark.createDataFrame([(float(v), "chair") for v in values], "displacement double, label string")
    envs = spark.createDataFrame([("r", 2)], "reference string, n_sessions int")
    assert scans.summary(envs, moves).first()["median_displacement"] == sorted(values)[350]
    assert scans.summary(envs, moves.limit(0)).first()["median_displacement"] == 0.0


def test_asof_looks_at_each_row_once(spark):
    """Frames that run to the end of a group are filled anew for each row: 5 billion steps on this one."""
    n = 100_000
    rows = spark.range(n).selectExpr("'hot' AS g", "2 * id AS t", "concat('f', id) AS f")
    asked = spark.range(n).selectExpr("'hot' AS g", "2 * id + 1 AS target")
    began = time.monotonic()
    told = planning.asof_forward(asked, rows, "g", "t", "f").groupBy(F.col("f") == F.concat(F.lit("f"), F.least((F.col("target") + 1) / 2, F.lit(n - 1)).cast("long"))).count().collect()
    assert [tuple(r) for r in told] == [(True, n)]
    assert time.monotonic() - began < 25


def test_asof_in_ranges_equals_one_range(spark):
    """Null and repeated times, times that are strings, groups with rows only or targets only."""
    rng = random.Random(8)
    time_ = lambda: None if rng.random() < 0.02 else f"{rng.choice([7, rng.randrange(3000)]):05}"
    rows = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), time_(), rng.choice([None, f"f{k}"])) for k in range(1500)] + [("rows", "1", "x"), ("blank", "1", None)], "g string, t string, f string")
    asked = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None, "gone", "blank"]), time_()) for _ in range(600)], "g string, target string")
    one, many = (sorted(map(str, planning.asof_forward(asked, rows, "g", "t", "f", n).collect())) for n in (10_000, 30))
    assert len(one) == 600 and one == many


def test_cut_points_deal_in_order(spark):
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, 'hot') AS g", "if(id % 3 = 0, 77, id) AS v")
    cuts = ranges.cut_points(rows, ["g"], "v", 200)
    told = ranges.dealt(rows, cuts, ["g"], "v").where("g = 'hot'").groupBy(ranges.RANGE).agg(F.countDistinct("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(ranges.RANGE).collect()
    assert len(told) > 16 and max(r["n"] for r in told) <= 400 and sum(r["n"] for r in told) == rows.where("g = 'hot'").select("v").distinct().count()
    assert all(a["high"] < b["low"] for a, b in zip(told, told[1:]))
    assert ranges.cut_points(rows, ["g"], "v") is None
