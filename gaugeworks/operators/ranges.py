"""Order inside groups of any size: ranges of bounded size, running totals and exact order statistics.

A window over a group that is ordered by a value puts the whole group into one task.  Here a group
with more than ``RANGE_ROWS`` rows is cut into ranges of its values, in rounds: approximate
percentiles (a small sketch for each range, combined before the shuffle) give ``WAYS`` cut points, and
each row's range is refined by them until every range is small or holds one value only.  Cut points
are data, joined back to the rows, so a task that is run again deals its rows alike.  Results are
exact, as ranges are counted exactly; the sketches only decide where to cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed

RANGE_ROWS, WAYS = 1_000_000, 64
RANGE = "__range"
ROUNDS = 8  # each appends a digit of base _BASE to a long
_BASE = 2 * (WAYS + 1) + 1
_SEEN = 8  # thinned values between two cut points


def joined(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``small`` on keys, in which null equals null."""
    told = small.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return rows.join(told, same, how).drop(*(f"__k{i}" for i in range(len(keys))))


def _cuts(rows: DataFrame, by: list[str], values: list[str], range_rows: int | None) -> DataFrame | None:
    """Cut points of the ranges that are too large: (by, range, which value cuts them, points of each); None if there are none."""
    keys = [*by, RANGE]
    told = [F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(f"__v{i}") for i, v in enumerate(values)]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *told).where(F.col("__n") > (range_rows or RANGE_ROWS))
    first = F.coalesce(*(F.when(F.col(f"__v{i}.low") < F.col(f"__v{i}.high"), F.lit(i)) for i in range(len(values))))
    large = sizes.select(*keys, first.alias("__which")).where("__which is not null")
    if large.isEmpty():
        return None
    points = [k / WAYS for k in range(1, WAYS)]
    some = lambda v: F.array_distinct(F.concat(F.array(F.min(v)), F.percentile_approx(v, points, 100 * WAYS)))
    return joined(rows, large, keys, "inner").groupBy(*keys, "__which").agg(*(some(v).alias(f"__p{i}") for i, v in enumerate(values)))


def _refined(rows: DataFrame, cuts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``rows`` with a further digit of their range: values between cut points, and each cut point alone."""
    below = lambda i, v: F.size(F.filter(f"__p{i}", lambda x: x < F.col(v))) + F.size(F.filter(f"__p{i}", lambda x: x <= F.col(v)))
    digit = F.coalesce(*(F.when(F.col("__which") == i, below(i, v)) for i, v in enumerate(values)), F.lit(0))
    out = joined(rows, cuts, [*by, RANGE]).withColumn(RANGE, F.col(RANGE) * _BASE + digit)
    return out.drop("__which", *(f"__p{i}" for i in range(len(values))))


def few(range_rows: int | None, *frames: DataFrame) -> bool:
    """Do all rows together fit into one range?  A count reads no columns, so it spares small tables the search for large groups."""
    return sum(f.count() for f in frames) <= (range_rows or RANGE_ROWS)


def ranged(rows: DataFrame, by: list[str], values: list[str], range_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``rows`` with the column ``__range``, and whether any group was cut.

    Ranges of a group follow the order of ``values`` (the first, then the next among equal ones; nulls first) and hold
    at most ``range_rows`` rows (``RANGE_ROWS`` unless given), unless those are alike in all values.
    """
    rows, cut = rows.withColumn(RANGE, F.lit(0).cast("long")), False
    for _ in range(ROUNDS):
        cuts = _cuts(rows, by, values, range_rows)
        if cuts is None:
            break
        rows, cut = checkpointed(_refined(rows, cuts, by, values)), True
    return rows, cut


def cut_points(rows: DataFrame, by: list[str], value: str, range_rows: int | None = None) -> DataFrame | None:
    """(by, ``__cuts``): for each group too large for one range, values in order that cut it; None if no group is.

    Distinct values are thinned by their hash, so the cuts are the same whenever they are asked for; every eighth that is left
    cuts, which gives ranges of about half of ``range_rows`` distinct values.  Only where to cut rests on the thinned values.
    """
    every = max(1, (range_rows or RANGE_ROWS) // (2 * _SEEN))
    some = rows.where(F.pmod(F.xxhash64(*by, value), F.lit(every)) == 0).groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("__seen"))
    cuts = checkpointed(some.select(*by, F.filter("__seen", lambda _, i: i % _SEEN == _SEEN - 1).alias("__cuts")).where(F.size("__cuts") > 0))
    return None if cuts.isEmpty() else cuts


def dealt(rows: DataFrame, cuts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``__range``: how many cut points of their group are at or below the value (none for null).

    The table of cut points is broadcast, two values for every ``range_rows`` distinct ones, and searched by halving; the steps are
    plain expressions, so that the generated code only points at the array and no row ever carries it.
    """
    longest = cuts.agg(F.max(F.size("__cuts"))).first()[0]
    out = joined(rows, F.broadcast(cuts), by).withColumn(RANGE, F.lit(0))
    for k in reversed(range(longest.bit_length())):
        out = out.withColumn(RANGE, F.col(RANGE) + F.when(F.get("__cuts", F.col(RANGE) + (1 << k) - 1) <= F.col(value), 1 << k).otherwise(0))
    return out.drop("__cuts")


def running_totals(rows: DataFrame, by: list[str], values: list[str], amounts: dict[str, str], range_rows: int | None = None) -> DataFrame:
    """Adds, for each name of ``amounts``, the sum of its column up to each row of the group in the order of ``values``.

    Ranges are summed by themselves; the totals of a group's earlier ranges, one row a range, are carried over.
    """
    rows, cut = (rows.withColumn(RANGE, F.lit(0).cast("long")), False) if few(range_rows, rows) else ranged(rows, by, values, range_rows)
    keys = [*by, RANGE]
    upto = Window.partitionBy(*keys).orderBy(*values).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(c).over(upto) for name, c in amounts.items()})
    if cut:
        before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        own = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"__own_{name}") for name, c in amounts.items()))
        carried = own.select(*keys, *(F.coalesce(F.sum(f"__own_{name}").over(before), F.lit(0)).alias(f"__before_{name}") for name in amounts))
        rows = joined(rows, carried, keys).withColumns({name: F.col(name) + F.col(f"__before_{name}") for name in amounts}).drop(*(f"__before_{name}" for name in amounts))
    return rows.drop(RANGE)


def running_total(rows: DataFrame, by: list[str], values: list[str], amount: str, name: str, range_rows: int | None = None) -> DataFrame:
    """``running_totals`` of one amount."""
    return running_totals(rows, by, values, {name: amount}, range_rows)


Rank = Callable[[Column], Column]


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Rank], by: list[str] | None = None, range_rows: int | None = None) -> DataFrame:
    """(by, __n, a column for each rank): exact values at ranks from 0, each a function of the group's number n of values.

    Values are counted first, so ties cost nothing.  A group with more than ``range_rows`` distinct values is
    narrowed in rounds to the ranges that hold its ranks: only these are counted further and put in order.
    Nulls are no values; a group without values, or a rank outside 0..n-1, gives null.
    """
    by = by or []
    per = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count(value).alias("__c")).withColumn(RANGE, F.lit(0).cast("long"))
    cuts = None if few(range_rows, rows) else _cuts(per, by, ["__v"], range_rows)
    if cuts is None:
        group = Window.partitionBy(*by)
        seen = per.withColumn("__upto", F.sum("__c").over(group.orderBy("__v"))).withColumn("__all", F.sum("__c").over(group))
        at = lambda rank: F.min(F.when((F.col("__upto") > rank(F.col("__all"))) & (rank(F.col("__all")) >= 0), F.col("__v")))
        return seen.groupBy(*by).agg(F.coalesce(F.max("__all"), F.lit(0)).alias("__n"), *(at(r).alias(name) for name, r in ranks.items()))
    sizes = checkpointed(per.groupBy(*by).agg(F.sum("__c").alias("__n")))
    told = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r(F.col("__n")).cast("long").alias("rank")) for name, r in ranks.items())))
    wanted = sizes.select(*by, F.lit(0).cast("long").alias(RANGE), told.alias("t")).select(*by, RANGE, F.col("t.name").alias("__name"), F.col("t.rank").alias("__rank"))
    keys = [*by, RANGE]
    for _ in range(ROUNDS):
        if cuts is None:
            break
        per = checkpointed(_refined(per, cuts, by, ["__v"]))
        up = Window.partitionBy(*by, "__from").orderBy(RANGE)
        totals = per.groupBy(*keys).agg(F.sum("__c").alias("__own")).withColumn("__from", F.floor(F.col(RANGE) / _BASE).cast("long"))
        totals = totals.withColumn("__upto", F.sum("__own").over(up)).withColumnRenamed(RANGE, "__to")
        found = joined(wanted, totals.withColumnRenamed("__from", RANGE), keys, "inner").where("__rank < __upto and __rank >= __upto - __own")
        wanted = checkpointed(found.select(*by, F.col("__to").alias(RANGE), "__name", (F.col("__rank") - F.col("__upto") + F.col("__own")).alias("__rank")))
        per = joined(per, wanted.select(*keys).distinct(), keys, "left_semi")
        cuts = _cuts(per, by, ["__v"], range_rows)
    seen = per.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")))
    found = joined(wanted, seen, keys, "inner").where("__rank < __upto").groupBy(*by, "__name").agg(F.min("__v").alias("__v"))
    found = found.groupBy(*by).agg(*(F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))
    return joined(sizes, found, by) if by else sizes.crossJoin(found)  # one row each


def index_rank(num: int, den: int) -> Rank:
    """The rank n * num // den, the last one at most."""
    return lambda n: F.least(F.floor(n * num / den), n - 1)


def linear_percentiles(rows: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None, range_rows: int | None = None) -> DataFrame:
    """(by, a column for each point q): linear interpolation at (n - 1) q between two exact ranks; null without values."""
    ranks: dict[str, Rank] = {}
    for name, q in points.items():
        ranks[f"__low_{name}"] = lambda n, q=q: F.floor((n - 1) * q)
        ranks[f"__high_{name}"] = lambda n, q=q: F.ceil((n - 1) * q)
    found = order_statistics(rows, value, ranks, by, range_rows)

    def between(name: str, q: float) -> Column:
        low, high, at = (F.col(c).cast("double") for c in (f"__low_{name}", f"__high_{name}", "__n"))
        at = (at - 1) * q
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*(by or []), *(between(name, q).alias(name) for name, q in points.items()))
