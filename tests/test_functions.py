"""Golden vectors and random differential tests of the scalar functions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import stats, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("x")).orderBy("i").collect()]


def test_relative_accuracy(spark):
    rows = [("1.0", 1.0, 1.0), ("1.1", 1.0, 0.9), ("1.5", 1.0, 0.1), ("0.5", 1.0, 0.1), ("2.0", 1.0, 0.0), ("3.0", 1.0, 0.0), ("-1.1", -1.0, 0.9), ("about 2.5 m", 2.5, 1.0), ("1,200 cm", 1200.0, 1.0), ("no idea", 1.0, 0.0), (None, 1.0, 0.0)]
    got = values(spark, [r[:2] for r in rows], "p string, t double", stats.relative_accuracy(text.parse_number(F.col("p")), F.col("t")))
    assert got == pytest.approx([r[2] for r in rows])


def test_relative_accuracy_needs_a_target(spark):
    with pytest.raises(Exception, match="other than 0"):
        one(spark, stats.relative_accuracy(F.lit(1.0), F.lit(0.0)))


def plain_number(s):
    s = s.strip().replace(",", "")
    try:
        v = float(s)
        return v if math.isfinite(v) else None
    except ValueError:
        m = re.search(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", s)
        v = float(m.group()) if m else None
        return v if v is not None and math.isfinite(v) else None


def test_parse_number_against_plain_python(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("0123456789.,-+eE_ xmd") for _ in range(rng.randrange(1, 9))) for _ in range(600)] + ["nan", "inf", "-Infinity", "1_0", "1__0", "1e400", " 7. ", "1.5d", "0x1p3", ""]
    assert values(spark, [(s,) for s in made], "s string", text.parse_number(F.col("s"))) == [plain_number(s) for s in made]


OPTIONS = [("A", "sink"), ("B", "drawer"), ("C", "top shelf"), ("D", "shelf"), ("E", text.UNANSWERABLE_TEXT)]
LETTERS = [
    ("B", None, "B"), ("b.", None, "B"), ("**B**", None, "B"), ("<b>C</b>", None, "C"), ("(c)", None, "C"), ("The answer is D.", None, "D"), ("answer: (a)", None, "A"), ("E) because", None, "E"), ("F", None, None), ("", None, None), (None, None, None),
    ("A drawer", 1, "A"), ("the top shelf", 1, "C"), ("drawer", 1, "B"), ("DRAWER ", 1, "B"), ("Not the drawer.", 1, None), ("It is in the sink or the drawer", 1, None), ("I cannot determine this.", 1, "E"), ("unable to tell", 1, "E"), ("unable to tell", None, None),
    ("The information is not available based on the given context.", 1, "E"), ("The answer is a drawer", 1, "A"), ("a < b", None, "A"),
]


def test_choice_letters(spark):
    options = F.when(F.col("o") == 1, F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(b).alias("text")) for a, b in OPTIONS)))
    got = values(spark, [r[:2] for r in LETTERS], "s string, o int", text.choice_letter(F.col("s"), options))
    assert got == [r[2] for r in LETTERS]


def test_wilson(spark):
    at = lambda k, n: one(spark, F.struct(*stats.wilson(F.lit(k), F.lit(n))))
    assert tuple(at(25, 66)) == pytest.approx((0.271, 0.499), abs=1e-3)
    assert tuple(at(25, 229)) == pytest.approx((0.075, 0.156), abs=1e-3)
    assert tuple(at(0, 0)) == (0.0, 0.0)
    assert at(0, 10)[0] == 0 and at(0, 10)[1] > 0.15
    low, high = at(4.5, 10)
    assert low < 0.45 < high


def test_binomial(spark):
    def exact(k, n, p):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        return min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-9)))

    rng = random.Random(2)
    rows = [(25, 66, 0.25)] + [(rng.randrange(n + 1), n, rng.choice([0.1, 0.25, 0.5])) for n in (1, 2, 5, 30, 90) for _ in range(4)]
    got = values(spark, rows, "k long, n long, p double", stats.binomial_two_sided(F.col("k"), F.col("n"), F.col("p")))
    assert got == pytest.approx([exact(*r) for r in rows], abs=1e-9)
    assert got[0] == pytest.approx(0.0220, abs=1e-4)


def test_percentiles(spark):
    rows = spark.createDataFrame([(0.0,), (100.0,)], "v double")
    assert rows.agg(stats.linear_percentile("v", 0.95)).first()[0] == pytest.approx(95.0)
    assert rows.where("v < 0").agg(stats.linear_percentile("v", 0.95)).first()[0] is None
    assert one(spark, stats.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, stats.index_percentile(F.array().cast("array<int>"), 9, 10)) is None


def test_likert_and_f1(spark):
    assert [one(spark, stats.likert(F.lit(x))) for x in (0.0, 1.0, 3.0, 9.0)] == [0.0, 0.0, 0.5, 1.0]
    f1 = lambda a, b: one(spark, text.token_f1(text.lexical_words(F.lit(a)), text.lexical_words(F.lit(b))))
    assert f1("", "") == 1.0 and f1("a", "") == 0.0 and f1("the the cat", "the cat!") == pytest.approx(0.8)


def test_destinations(spark):
    from gaugeworks.plans.scoring import NARRATIONS

    d = text.destination(F.col("n"), F.col("v"))
    got = values(spark, [(n, v) for _, n, v, _, _ in NARRATIONS], "n string, v string", d)
    assert [tuple(x) if x else (None, None) for x in got] == [(h, s) for *_, h, s in NARRATIONS]


def test_refusals_and_repetition(spark):
    from gaugeworks.operators.report import output_diagnostics

    rows = spark.createDataFrame([(0, "I can’t see the video."), (1, "the cat sat down " * 8), (2, "  "), (3, None), (4, "一 二 三")], "i int, t string")
    got = {r["i"]: r for r in output_diagnostics(rows, "t").collect()}
    assert got[0]["refusal"] and not got[1]["refusal"]
    assert got[1]["repetitive"] and got[1]["tokens_approx"] == 32
    assert got[2]["empty"] and got[3]["empty"] and got[3]["tokens_approx"] == 0
    assert got[4]["tokens_approx"] == 3


def test_escapes(spark):
    assert one(spark, text.html_escape(F.lit("<a b='1'>\"&"))) == "&lt;a b=&#x27;1&#x27;&gt;&quot;&amp;"
    assert one(spark, text.slug(F.lit("a/b c-é_1.2"))) == "a_b_c-é_1.2"
