"""The choice of questions in rounds against the walk it stands for."""

import random

import pytest

from gaugeworks.operators import mining

MOVES = "env_id string, ord int, scan int, subject string, gold string, displacement double"


def walk(moves, cap):
    """Taken moves of each environment, one after the other, as the rule is told."""
    taken = []
    for env in sorted({m[0] for m in moves}, key=str):
        subjects, asked, n = set(), set(), 0
        for m in sorted((m for m in moves if m[0] == env), key=lambda m: (-(m[5] if m[5] is not None else float("-inf")), m[1])):
            s, g = m[3].lower(), m[4].lower()
            if n == cap or not s or not g or s in mining.UNUSABLE or g in mining.UNUSABLE:
                continue
            if s not in subjects and (m[2], g, s) not in asked:
                taken.append(m)
                subjects.add(s)
                asked.add((m[2], s, g))
                n += 1
    return taken


@pytest.mark.parametrize("cap", [4, 1, 2, None])
def test_rounds_equal_the_walk(spark, cap):
    rng = random.Random(11)
    labels = ["Chair", "chair", "LAMP", "bed", "Sofa", "box", "wall", ""]
    moves = [(rng.choice(["a", "a", "a", "b", "c", None]), k, rng.randrange(2), rng.choice(labels), rng.choice(labels), rng.choice([1.0, 2.0, 3.5, rng.random() * 9, None])) for k in range(260)]
    out = mining.mine_environment(spark.createDataFrame(moves, MOVES), cap)
    assert out.columns == ["env_id", "ord", "scan", "subject", "gold", "displacement"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(walk(moves, cap), key=str)


def test_chains_of_mirrors(spark):
    """Each move waits for the one before it: a mirror frees the next subject only once it is decided itself."""
    moves = [("e", k, 0, f"s{k // 2 + k % 2}", f"s{k // 2 + 1 - k % 2}", float(100 - k)) for k in range(30)] + [("e", 99, 0, "s3", "s3", 500.0), ("e", 98, 0, "s3", "s3", 500.0)]
    for cap in (3, None):
        got = mining.mine_environment(spark.createDataFrame(moves, MOVES), cap).collect()
        assert sorted(map(tuple, got)) == sorted(walk(moves, cap))


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([("e", 1, 0, "wall", "chair", 2.0), ("e", 2, 0, "chair", None, 2.0)], MOVES)
    assert mining.mine_environment(rows).collect() == []
    assert mining.mine_environment(rows.limit(0), None).collect() == []


@pytest.mark.parametrize("walked", [4, 9, 30])
def test_environments_short_after_their_walk_go_on_in_rounds(spark, monkeypatch, walked):
    """Few moves are walked, so some environments have more and are short of their cap; others are done."""
    monkeypatch.setattr(mining, "WALKED", walked)
    rng = random.Random(12)
    labels = ["Chair", "chair", "LAMP", "bed", "Sofa", "box", "wall"]
    moves = [(env, k, rng.choice([None, 0, 1]), rng.choice(labels), rng.choice(labels), rng.choice([1.0, 2.0, rng.random() * 9, None])) for k, env in enumerate(["a", "a", "b", None] * 50 + ["c"] * 3 + ["d"] * 12)]
    moves += [("e", 1000 + k, 0, "bed", rng.choice(labels), 50.0) for k in range(40)] + [("e", 2000 + k, 0, rng.choice(labels), "bed", 9.0) for k in range(20)]
    rounds, real = [], mining._rounds
    monkeypatch.setattr(mining, "_rounds", lambda rows, cap: rounds.append({r[0] for r in rows.select("env_id").distinct().collect()}) or real(rows, cap))
    got = mining.mine_environment(spark.createDataFrame(moves, MOVES), 4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(walk(moves, 4), key=str)
    assert len(rounds) == 1 and "e" in rounds[0] and "c" not in rounds[0]


def test_only_what_is_taken_is_written(spark, monkeypatch):
    """Checkpoints hold a row for each environment, not its moves in every round."""
    written, real = [], mining.checkpointed

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(mining, "checkpointed", counted)
    rng = random.Random(13)
    moves = [(f"e{k % 20}", k, 1, f"s{rng.randrange(40)}", "sofa", rng.random()) for k in range(3000)]
    got = mining.mine_environment(spark.createDataFrame(moves, MOVES), 4).collect()
    assert sorted(map(tuple, got)) == sorted(walk(moves, 4))
    assert sum(written) <= 20
