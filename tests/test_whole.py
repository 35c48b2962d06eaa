"""Queries over whole tables against brute force, where their SQL does not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.operators import geometry


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Labels 0, 1 and null, ids that differ modulo 100, equal vectors, and a difference past component 8 only."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(160, 64)).astype(np.float32)
    v[150] = v[7]
    v[151] = v[7]
    v[152] = np.where(np.arange(64) < 8, v[9], -v[9])
    v[153] = 0
    rows = [(i, [int(i % 3 > 0), 0][i >= 150] if i != 149 else None, [float(x) for x in v[i]]) for i in range(160)]
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def others(rows, measure):
    """Each vector's (value, id) of the others of its label, in order."""
    out = {}
    for i, a, v in rows:
        if a is not None:
            out[i] = sorted((measure(np.array(v), np.array(w)), j) for j, b, w in rows if a == b and i != j)
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbours_of_whole_labels(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(geometry, "BLOCK", block)
    folder, rows = vectors
    want = others(rows, lambda v, w: float(np.sqrt(((v - w) ** 2).sum())))
    got = {r["vec_id"]: r for r in plans.QUERIES["nearest_neighbours"](spark, folder).collect()}
    assert {i: r["nn_id"] for i, r in got.items()} == {i: w[0][1] for i, w in want.items()}
    assert all(r["dist"] == pytest.approx(want[i][0][0], abs=1e-6) for i, r in got.items())
    margins = {r["vec_id"]: r for r in plans.QUERIES["nn_margin"](spark, folder).collect()}
    assert margins.keys() == want.keys()
    assert all(r["margin"] == pytest.approx(want[i][1][0] - want[i][0][0], abs=1e-6) for i, r in margins.items())
    assert all(r["kept"] == (want[i][1][0] - want[i][0][0] >= 0.05) for i, r in margins.items())
    pairs = {(r["a"], r["b"]) for r in plans.QUERIES["reciprocal_pairs"](spark, folder).collect()}
    assert pairs == {(i, w[0][1]) for i, w in want.items() if i < w[0][1] and want[w[0][1]][0][1] == i}


@pytest.mark.parametrize("block", [2048, 16])
def test_cosine_of_whole_labels(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(geometry, "BLOCK", block)
    folder, rows = vectors
    cos = lambda v, w: -round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9) if v.any() and w.any() else 2.0
    want = {(i, k + 1, j) for i, w in others(rows, cos).items() for k, (_, j) in enumerate(w[:3])}
    assert {(r["vec_id"], r["rank"], r["other_id"]) for r in plans.QUERIES["cosine_topk"](spark, folder).collect()} == want


def test_greedy_cover_of_all_parts(spark, tmp_path):
    rng = np.random.default_rng(4)
    pairs = {(int(p), int(s)) for p, s in zip(rng.integers(1, 200, 500), rng.integers(1, 30, 500), strict=True)}
    spark.createDataFrame(sorted(pairs), "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 30)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    cost = {s: float(s % 7) or 3.0 for s in range(1, 30)}
    left, want, spent = set(pairs), [], 0.0
    while left:
        per = {p: sum(q == p for q, _ in left) for p, _ in left}
        value = lambda s: sum(1 + 4 * (per[p] == 1) for p, t in left if t == s) / cost[s]  # noqa: B023, E731
        best = min({s for _, s in left}, key=lambda s: (-value(s), cost[s], f"s{s}"))
        if spent + cost[best] > 20.0:
            break
        spent += cost[best]
        want.append((len(want), f"s{best}", spent))
        left = {(p, s) for p, s in left if s != best}
    got = [tuple(r) for r in plans.QUERIES["greedy_cover"](spark, str(tmp_path)).orderBy("step").collect()]
    assert got == want


def test_overlaps_with_all_orders(spark, tmp_path):
    spans = [(1, 1, 1, 10.0), (7, 2, 3, 30.0), (14, 1, 4, 5.0), (990, 3, 3, 50.0), (8, 4, 1, 0.0)]
    orders = [(1, 0), (2, 0), (5, 2), (9, 2), (13, 3), (985, 102)]
    spark.createDataFrame(spans, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for k, n, video, q in spans:
        for o, c in orders:
            lo, hi = max(k % 1000, o % 1000), min(k % 1000 + q, o % 1000 + 20)
            if c % 100 + 1 == video and hi > lo:
                want.add((k * 10 + n, o, float(lo), float(hi)))
    got = [tuple(r) for r in plans.QUERIES["interval_overlap_join"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and any(o % 5 for _, o, _, _ in got)


def test_subset_of_all_events(spark, tmp_path):
    rows = [(7, 1, "click"), (8, 1, "error"), (9, 2, "view"), (14, 3, "signup"), (15, 3, "purchase")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in plans.QUERIES["subset_filter"](spark, str(tmp_path)).collect()} == {(1, False), (2, True), (3, True)}
