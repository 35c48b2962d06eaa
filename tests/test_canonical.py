"""Canonical JSON against Python's writer."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from gaugeworks.functions import ids


def plain(text):
    try:
        told = json.dumps(json.loads(text, object_pairs_hook=once), sort_keys=True, ensure_ascii=False, allow_nan=False)
        return told, hashlib.sha256(told.encode()).hexdigest()
    except (TypeError, ValueError):
        return None, None


def once(pairs):
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key is repeated")
    return dict(pairs)


def some_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -5, 10**rng.randrange(50), -(10 ** rng.randrange(45)) + 7])
    if kind == 2:
        return round(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 25), rng.randrange(6)) if rng.random() < 0.5 else float(f"{rng.randrange(1, 10**rng.randrange(1, 15))}e{rng.randrange(-200, 200)}")
    if kind < 6:
        return "".join(rng.choices(['"', "\\", "/", ",", ":", "{", "é", "中", "\U0001f600", "\n", "\t", "\x01", "\x1f", "\x7f", " ", "a", "n", "s", "u0001n1", "1.0", " "], k=rng.randrange(8)))
    if kind == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(['a', 'B', '"', "\\", "é", ":", "\x01n", "0"], k=rng.randrange(1, 4))): some_value(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_canonical_form_equals_the_writer(spark):
    rng = random.Random(1)
    texts = [json.dumps(some_value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]), separators=rng.choice([None, (",", ":"), (" , ", " : ")])) for _ in range(700)]
    texts += ["1.0", "-0", "-0.0", "[1E5,1e-7,2.50,1.5E+300,100000000000000000000.0,1e16,1e15,123456789012345.0,0.0001,0.00001,12e3]", "1e400", "[-1e999]", "01", "1.", "+1", ".5", "1 2", "[1,]", "{'a':1}", "nope", "NaN", "[Infinity]", "", " ", "null", None]
    texts += ['{"a":1,"a":2}', '"\\ud800"', '"\\udc00x"', '"\\ud83d\\ude00"', '"\\\\ud800"', '"\\u0001n1.0"', '"\\u0001s"', '"\x01"', "[1] x", '"a', '{"b":{"z":1,"a":[{"y":2,"x":"é,:"}]},"a":null}', "9" * 60, "-" + "9" * 39]
    texts += [json.dumps("\\\n\"" * 30_000), json.dumps([1.5, "x"] * 5_000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ids.canonical_json(F.col("t")).alias("form"), ids.canonical_digest("t").alias("digest"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        assert (r["form"], r["digest"]) == plain(texts[r["k"]]), repr(texts[r["k"]])[:300]
