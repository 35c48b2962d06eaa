"""Budgets and covers against the sequential rules they stand for."""

import random

import pytest

from gaugeworks.operators import planning


def walk(rows, most, limit):
    used, n, out = set(), 0, {}
    for o, history in sorted(rows):
        both = used | set(history or [])
        out[o] = "video_budget" if len(both) > most else "item_limit" if n >= limit else "chosen"
        if out[o] == "chosen":
            used, n = both, n + 1
    return out


@pytest.mark.parametrize(("most", "limit", "folded"), [(6, 40, 2), (3, 5, 1000), (9, 1000, 2), (0, 9, 1000), (4, 0, 2)])
def test_budget_verdicts_equal_the_walk(spark, monkeypatch, most, limit, folded):
    monkeypatch.setattr(planning, "FOLDED", folded)
    rng = random.Random(most * 100 + limit)
    rows = [(k * 3, [rng.choice([*"abcdefghijkl", None]) for _ in range(rng.choice([0, 1, 1, 2, 3, 7]))] if rng.random() < 0.95 else None) for k in range(150)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "ord int, history array<string>")
    want = walk(rows, most, limit)
    judged = planning.budget_verdicts(frame, "ord", most, limit)
    assert judged.columns == ["ord", "history", "verdict"] and {r["ord"]: r["verdict"] for r in judged.collect()} == want
    chosen, excluded = planning.plan_budget(frame, "ord", most, limit)
    assert [r["ord"] for r in chosen] == sorted(o for o, v in want.items() if v == "chosen")
    assert excluded == {v: sum(x == v for x in want.values()) for v in planning.VERDICTS}


def greedy(pairs, size, budget, mean):
    """One session at a time."""
    cost = lambda s: size.get(s) or mean
    left = {}
    for c, s in pairs:
        left.setdefault(c, set()).add(s)
    out, spent, open_ = [], 0.0, {s for _, s in pairs}
    while open_:
        told = [(-(4 * sum(left[c] == {s} for c in left) + sum(s in left[c] for c in left)) / max(cost(s), 0.01), cost(s), s) for s in open_]
        _, own, s = min(told)
        if budget and spent + own > budget:
            break
        spent += own
        out.append((len(out), s, spent))
        open_.remove(s)
        for c in left:
            left[c].discard(s)
    return out


@pytest.mark.parametrize(("batch", "budget", "seed"), [(256, 30.0, 2), (4, 25.0, 3), (3, 0.0, 5)])
def test_greedy_cover_equals_single_steps(spark, monkeypatch, batch, budget, seed):
    monkeypatch.setattr(planning, "BATCH", batch)
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(9)]
    pairs = [(c, s) for c in range(25) for s in rng.sample(names, rng.choice([1, 2, 2, 3, 5]))]
    size = {s: rng.choice([0.0, 0.5, 1.0, 2.0, 7.0, 7.0]) for s in names[2:]}
    frame = spark.createDataFrame(pairs + pairs[:5], "candidate int, session string")
    out = planning.greedy_cover(frame, spark.createDataFrame(list(size.items()), "session string, size double"), budget, 2.5)
    assert [tuple(r) for r in out.orderBy("step").collect()] == greedy(pairs, size, budget, 2.5)


def test_a_round_takes_many_sessions(spark, monkeypatch):
    """Sessions that share few candidates are taken in a few rounds."""
    rounds = []
    own = planning._sure_places
    monkeypatch.setattr(planning, "_sure_places", lambda *a: rounds.append(own(*a)) or rounds[-1])
    pairs = [(c * 100 + k, f"s{c}") for c in range(60) for k in range(90 - c)] + [(100, "s3"), (5000, "s7")]
    sizes = spark.createDataFrame([(f"s{c}", 1.0) for c in range(60)], "session string, size double")
    out = planning.greedy_cover(spark.createDataFrame(pairs, "candidate int, session string"), sizes, 0.0, 1.0)
    assert out.count() == 60 and len(rounds) <= 3
