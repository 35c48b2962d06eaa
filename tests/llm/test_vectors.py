"""Vector operators: repeated ids, several dimensions, blocks and shards, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import pq, vptree

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v], a) for i, v, a in rows], SCHEMA)


def brute(rows, threshold=0.93):
    """Links and smallest id of the component of each row."""
    n = len(rows)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    linked = [[i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in range(n) if linked[i][j])]) for i in range(n)]
    least = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in root}
    return sorted((rows[i][0], sum(linked[i]), least[root[i]]) for i in range(n))


def crowd(n=150, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(1, n, 2):
        x[i] = x[i - 1] + rng.normal(scale=0.15, size=dim)
    return x


@pytest.mark.parametrize("block", [16_384, 20])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    rows = [(i, v, int(i >= 90)) for i, v in enumerate(crowd())] + [(200 + i, v[:7], 0) for i, v in enumerate(crowd(20, seed=3))]
    got = pq.near_duplicates(table(spark, rows)).collect()
    want = brute(rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want and sum(n for _, n, _ in want) > 60
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_repeated_ids_are_separate_vectors(spark):
    x = crowd(40)
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(1, x[20], 0), (1, x[1], 0), (7, x[30], 0), (7, x[30], 0)]
    got = sorted((r["vec_id"], r["n_links"]) for r in pq.near_duplicates(table(spark, rows)).collect())
    assert got == [(i, n) for i, n, _ in brute(rows)]


def test_extreme_lengths(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [1.0, 1.0], 0), (2, [1e-200, 1.01e-200], 0), (3, [-1.0, 1.0], 0)]
    got = {r["vec_id"]: r["component_id"] for r in pq.near_duplicates(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_the_share_of_lists_that_clustered_vectors_probe():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] * 3 + rng.normal(size=(4000, 24)) * 0.4).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    index, radius = pq.Index(unit, 8), np.sqrt(2 - 2 * 0.93)
    found = set()
    for q, y in index.near_pairs(unit, radius):
        found |= set(zip(q.tolist(), y.tolist(), strict=True))
    close = set(zip(*(a.tolist() for a in np.nonzero(unit @ unit.T >= 0.93)), strict=True))
    assert close <= found
    assert index.probed / len(x) ** 2 < 0.3


def ranks(rows, k, modulo=5):
    out = set()
    for q, v, _ in rows:
        if q % modulo == 0:
            others = [(float(vptree.inner_products(np.array([v]), np.array([w]))[0]), i) for i, w, _ in rows if i != q and len(w) == len(v)]
            out |= {(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(others, key=lambda p: (-p[0], p[1]))[:k])}
    return out


@pytest.mark.parametrize("shard", [32_768, 30])
def test_search_with_ties_repeats_and_dimensions(spark, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
    x = crowd(120)
    x[30:60] = x[29]  # ties
    x[100] = x[99] * 3
    x[101] = x[99] + 1e-11  # apart by less than a rounded distance shows
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(300 + i, v[:4], 0) for i, v in enumerate(crowd(30, seed=5))]
    got = vptree.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, 7).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == ranks(rows, 7) and len(got) == len(ranks(rows, 7))


def test_repeated_ids_in_the_search(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [5.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [3.0, 1.0], 0), (2, [0.5, 9.0], 0)]
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in vptree.nearest(table(spark, rows[1:]), F.col("vec_id") == 0, 20).collect())
    assert got == [(0, 1, 10.0), (0, 1, 15.0), (0, 2, 2.5)]
