"""Statistics as Column expressions: intervals, accuracy, tests and the three kinds of percentile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054
#: The ten tolerances 1 - threshold of mean relative accuracy, as doubles.
MRA_TOLERANCES = [0.5, 0.44999999999999996, 0.4, 0.35, 0.30000000000000004, 0.25, 0.19999999999999996, 0.15000000000000002, 0.10000000000000009, 0.050000000000000044]


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval; (0, 0) for n <= 0; successes may be fractional."""
    n = n.cast("double")
    p, zz = F.try_divide(successes.cast("double"), n), F.lit(z * z)
    denominator = 1 + F.try_divide(zz, n)
    centre = F.try_divide(p + F.try_divide(zz, 2 * n), denominator)
    radicand = F.greatest(F.try_divide(p * (1 - p), n) + F.try_divide(zz, 4 * n * n), F.lit(0.0))
    margin = F.try_divide(z * F.sqrt(radicand), denominator)
    empty = n <= 0
    low = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin))
    return low, F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), centre + margin))


def relative_accuracy(pred: Column, target: Column) -> Column:
    """Mean relative accuracy over the ten thresholds; 0 for a prediction without a number; target 0 raises."""
    error = F.when(target == 0, F.raise_error(F.lit("relative accuracy needs a target other than 0")).cast("double")).otherwise(F.abs(pred - target) / F.abs(target))
    hits = sum(((error <= t).cast("int") for t in MRA_TOLERANCES), F.lit(0))
    return F.when(pred.isNull(), 0.0).otherwise(hits / F.lit(10.0))


def likert(raw: Column) -> Column:
    """A 1 to 5 judgement on the unit scale, clipped."""
    return (F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw)) - 1) / 4


def upper_median(values: Column) -> Column:
    """``sorted[n // 2]`` of an array."""
    return index_percentile(values, 1, 2)


def index_percentile(values: Column, num: int, den: int) -> Column:
    """``sorted[n * num // den]`` of an array, the last element at most; null when empty."""
    at = F.least(F.floor(F.size(values) * num / den), F.size(values) - 1).cast("int")
    return F.get(F.sort_array(values), at)


def linear_percentile(column: str, q: float) -> Column:
    """Linear interpolation at (n - 1) q, as an aggregate."""
    return F.percentile(column, F.lit(q))


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    """Exact two-sided binomial test: the probability of outcomes no likelier than k of n.

    Log probabilities come from the recurrence log pmf(i) = log pmf(i - 1) + log((n - i + 1) / i) + log(p / q), so large
    n neither overflows nor loses the tail.  It is run twice, first up to k, then adding up what is no likelier, and holds two numbers.
    """
    step, begin = F.ln(p) - F.ln(1 - p), (n * F.ln(1 - p)).cast("double")
    following = lambda last, i: last + F.ln((n - i + 1) / i) + step
    upto = lambda m: F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m.cast("long"))).otherwise(F.array().cast("array<long>"))
    seen = F.aggregate(upto(k), begin, following)

    def add(bound: Column) -> Column:
        counted = lambda x: F.when(x <= bound, F.exp(x)).otherwise(0.0)

        def grow(acc: Column, i: Column) -> Column:
            now = following(acc["last"], i)
            return F.struct(now.alias("last"), (acc["total"] + counted(now)).alias("total"))

        return F.aggregate(upto(n), F.struct(begin.alias("last"), counted(begin).alias("total")), grow)["total"]

    total = F.transform(F.array(seen + 1e-9), add)[0]  # the bound is computed once
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), total))
