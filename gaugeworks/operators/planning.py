"""Planning: eligibility cascades, budgets, greedy covers, intervals, as-of joins and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import checkpointed
from . import ranges


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is true; null when none is."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules))


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return rows.groupBy(key).agg(F.min(value).alias("value"), F.countDistinct(value).alias("d")).where("d = 1").select(F.col(key).alias("key"), "value")


def overlaps(spans: DataFrame, chunks: DataFrame, on: str, width: float) -> DataFrame:
    """(span_id, chunk_id, lo, hi) of spans and chunks of the same recording with hi > lo.

    Both sides are cut into buckets of ``width`` and joined on recording and bucket; a pair counts
    in the bucket where its overlap begins, so a long recording is spread over many tasks.
    """
    cut = lambda df: df.where("stop > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    s, c = cut(spans).alias("s"), cut(chunks).alias("c")
    lo, hi = F.greatest("s.start", "c.start"), F.least("s.stop", "c.stop")
    both = s.join(c, (F.col(f"s.{on}") == F.col(f"c.{on}")) & (F.col("s.__b") == F.col("c.__b")))
    return both.where((hi > lo) & (F.floor(lo / width) == F.col("s.__b"))).select("s.span_id", "c.chunk_id", lo.alias("lo"), hi.alias("hi"))


def visible_counts(queries: DataFrame, values: DataFrame, cutoff: str, value: str, key: str, range_rows: int | None = None) -> DataFrame:
    """(key, n_visible): values up to each query's cutoff, all for -1.

    A running count over distinct values replaces the range join: its size is that of the distinct
    values and cutoffs, not of their product, and it is spread over ranges of them.
    """
    per = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    asked = queries.select(F.col(cutoff).alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))
    marks = per.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n"))
    seen = ranges.running_total(marks, [], ["v"], "n", "seen", range_rows).select("v", "seen")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = queries.join(seen, F.col(cutoff) == F.col("v")).crossJoin(F.broadcast(total))
    return out.select(key, F.when(F.col(cutoff) == -1, F.col("total")).otherwise(F.col("seen")).alias("n_visible"))


def asof_forward(targets: DataFrame, rows: DataFrame, group: str, time: str, value: str, range_rows: int | None = None) -> DataFrame:
    """Each target with the first row of its group at or after it, or else the group's last row.

    Rows of one time are folded to their least and greatest value first.  Frames run from late to early, so each row
    is looked at once.  A group of any size is spread over ranges of its times; a row ahead of each range holds what
    follows it: the next range's first value, or the group's last one.
    """
    at, told = rows.schema[time].dataType, rows.schema[value].dataType
    seen = rows.select(group, F.col(time).alias("__t"), F.col(value).alias("__value")).where("__value is not null")
    asked = targets.select(group, F.col("target").cast(at).alias("__t"))
    marks = seen.groupBy(group, "__t").agg(F.min("__value").alias("__value"), F.max("__value").alias("__end")).withColumn("__asked", F.lit(0))
    marks = marks.unionByName(asked.withColumns({"__value": F.lit(None).cast(told), "__end": F.lit(None).cast(told), "__asked": F.lit(1)}))
    cuts = None if ranges.few(range_rows, rows, targets) else ranges.cut_points(seen.select(group, "__t").unionByName(asked), [group], "__t", range_rows)
    if cuts is None:
        marks = marks.withColumn(ranges.RANGE, F.lit(0))
    else:
        marks = ranges.dealt(marks, cuts, [group], "__t").unionByName(_following(ranges.dealt(seen, cuts, [group], "__t"), cuts, group), allowMissingColumns=True)
    late = Window.partitionBy(group, ranges.RANGE).orderBy(F.col("__asked") >= 0, F.desc("__t"), "__asked")
    ahead = F.last("__value", ignorenulls=True).over(late.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.first("__end", ignorenulls=True).over(late.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = marks.withColumns({"__ahead": ahead, "__end": end}).where("__asked = 1")
    return found.select(group, F.col("__t").cast(targets.schema["target"].dataType).alias("target"), F.coalesce("__ahead", "__end").alias(value))


def _following(seen: DataFrame, cuts: DataFrame, group: str) -> DataFrame:
    """A row for each range of each group: the first value of the ranges after it, or else the group's last value."""
    mark = F.struct("__t", "__value")
    own = seen.groupBy(group, ranges.RANGE).agg(F.min(mark).alias("__begin"), F.max(mark).alias("__last"))
    every = ranges.joined(own.select(group).distinct(), cuts, [group]).select(group, F.explode(F.sequence(F.lit(0), F.coalesce(F.size("__cuts"), F.lit(0)))).alias(ranges.RANGE))
    late = Window.partitionBy(group).orderBy(F.desc(ranges.RANGE))
    after = F.last("__begin", ignorenulls=True).over(late.rowsBetween(Window.unboundedPreceding, -1))
    last = F.first("__last", ignorenulls=True).over(late.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = ranges.joined(every, own, [group, ranges.RANGE]).withColumns({"__after": after, "__final": last})
    return out.select(group, ranges.RANGE, F.coalesce("__after", "__final")["__value"].alias("__value"), F.lit(-1).alias("__asked"))


def fixed_chunks(rows: DataFrame, end: str, size: float, guard: float = 0.001) -> DataFrame:
    """Adds idx, start and stop of chunks over [0, end), while start < end - guard."""
    n = F.greatest(F.ceil((F.col(end) - guard) / size), F.lit(0)).cast("int")
    out = rows.withColumn("idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.withColumns({"start": F.col("idx") * size, "stop": F.least((F.col("idx") + 1) * size, F.col(end))})


def midpoints(start: Column, end: Column, n: Column) -> Column:
    """n times in the middle of equal parts of [start, end]."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (end - start) / n * (i + 0.5))


def window_frames(start: Column, end: Column, fps: float) -> Column:
    return F.greatest(F.lit(1), F.ceil((end - start) * fps)).cast("int")


VERDICTS = ("video_budget", "item_limit")
FOLDED, BATCH = 1_000, 256


def budget_verdicts(eligible: DataFrame, order: str, max_videos: int, limit: int) -> DataFrame:
    """``eligible`` (``order``, history) with ``verdict``: chosen, video_budget or item_limit.

    As if rows were walked by ``order`` (unique): a row whose history and the videos used so far are more than
    ``max_videos`` together is over the budget; others are chosen until there are ``limit``.  Only rows that add
    videos change the walk.  A row that is over the budget stays so, as the used videos only grow, so
    the adding rows are folded in order, ``FOLDED`` at a time, at most ``max_videos`` of them with effect; all other
    rows are judged by themselves, from the place in the order where each video came into use.
    """
    seen = F.array_distinct(F.coalesce("history", F.array().cast(eligible.schema["history"].dataType)))
    rows = eligible.withColumn("__h", seen)
    kind, item = eligible.schema[order].dataType, eligible.schema["history"].dataType.elementType
    since: dict = {}  # video -> the order of the row that brought it
    at = None
    while len(since) < max_videos:
        new = F.size(F.array_except("__h", _literals(list(since), item)))
        more = rows.where((new > 0) & (new + len(since) <= max_videos))
        more = more.where(F.col(order) > F.lit(at)) if at is not None else more
        got = more.select(order, "__h").orderBy(order).limit(FOLDED).collect()
        for o, history in got:
            if len(since.keys() | set(history)) <= max_videos:
                since |= {v: o for v in history if v not in since}
        if len(got) < FOLDED:
            break
        at = got[-1][0]
    came = F.map_from_arrays(_literals([v for v in since if v is not None], item), _literals([o for v, o in since.items() if v is not None], kind))
    blank = F.lit(since.get(None)).cast(kind)  # when the null video came, as maps have no null keys

    def together(row: Column, end: Column | None) -> Column:
        """How many videos are used by the rows before ``row``, of those up to ``end``, and by the row's history."""
        here = lambda o: F.coalesce((o < row) & (F.lit(True) if end is None else o <= end), F.lit(False))
        return F.size(F.filter(_literals(list(since.values()), kind), here)) + F.size(F.filter("__h", lambda v: ~here(F.when(v.isNull(), blank).otherwise(F.try_element_at(came, v)))))

    fits = together(F.col(order), None) <= max_videos
    last = ranges.order_statistics(rows.where(fits), order, {"last": lambda n: F.lit(limit - 1)}).first()["last"] if limit > 0 else None
    if limit <= 0:
        verdict = F.when(F.size("__h") > max_videos, VERDICTS[0]).otherwise(VERDICTS[1])
    elif last is None:
        verdict = F.when(fits, "chosen").otherwise(VERDICTS[0])
    else:
        end = F.lit(last).cast(kind)
        verdict = F.when(together(F.col(order), end) > max_videos, VERDICTS[0]).when(F.col(order) > end, VERDICTS[1]).otherwise("chosen")
    return rows.withColumn("verdict", verdict).drop("__h")


def _literals(values: list, kind) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(T.ArrayType(kind))


def plan_budget(eligible: DataFrame, order: str, max_videos: int, limit: int) -> tuple[list, dict[str, int]]:
    """The chosen rows of ``budget_verdicts`` in order, ``limit`` at most, and how many others there are by reason."""
    judged = budget_verdicts(eligible, order, max_videos, limit)
    counts = {r["verdict"]: r["count"] for r in judged.groupBy("verdict").count().collect()}
    return judged.where("verdict = 'chosen'").drop("verdict").orderBy(order).collect(), {v: counts.get(v, 0) for v in VERDICTS}


def greedy_cover(candidates: DataFrame, sizes: DataFrame, budget: float, mean_size: float) -> DataFrame:
    """(step, session, spent): sessions by value for size until the best one is over the budget.

    A session's value is four times the candidates it completes plus those it brings closer, over its size; a zero or
    unknown size counts as the mean; ties go to the smaller size, then the name.  Candidates are pairs (candidate, session).

    The order is that of choosing one session at a time, but a round takes as many as it can.  Let the ``BATCH`` best
    sessions by present value be taken in that order.  A value only grows, and only when a candidate's
    last but one session is taken; so it is known when each value grows, and at which place the grown value would
    stand.  Up to the first place that such a value would take from the one listed, the list is the
    sequential choice.  Only the batch and that place come to the driver.  Rounds grow with the times that a grown value
    overtakes the list: one for sessions that share no candidates, as many as sessions at worst.
    """
    spark = candidates.sparkSession
    cost = F.when(F.coalesce("size", F.lit(0.0)) == 0, mean_size).otherwise(F.col("size"))
    pairs = checkpointed(candidates.join(sizes, "session", "left").select("candidate", "session", cost.cast("double").alias("cost")).distinct())
    worth = lambda completes, partial: (4 * completes + partial) / F.greatest("cost", F.lit(0.01))
    chosen: list[tuple[int, str, float]] = []
    spent = 0.0
    while True:
        left = pairs.groupBy("candidate").agg(F.count("*").alias("left"))
        per = pairs.join(left, "candidate").groupBy("session").agg(F.count_if(F.col("left") == 1).alias("completes"), F.count("*").alias("partial"), F.first("cost").alias("cost"))
        per = checkpointed(per)
        top = per.select("session", worth(F.col("completes"), F.col("partial")).alias("value"), "cost").orderBy(F.desc("value"), "cost", "session").limit(BATCH).collect()
        affordable, total = 0, spent
        while affordable < len(top) and not (budget and total + top[affordable]["cost"] > budget):
            total += top[affordable]["cost"]
            affordable += 1
        if not affordable:
            break
        sure = _sure_places(spark, pairs, per, top, worth)
        for row in top[: min(sure, affordable)]:
            spent += row["cost"]
            chosen.append((len(chosen), row["session"], spent))
        if sure > affordable < len(top):
            break  # the next one is surely the best, and over the budget
        taken = spark.createDataFrame([(r["session"],) for r in top[: min(sure, affordable)]], "session string")
        pairs = checkpointed(pairs.join(F.broadcast(taken), "session", "left_anti"))  # BATCH rows at most
    return spark.createDataFrame(chosen, "step int, session string, spent double")


def _sure_places(spark, pairs: DataFrame, per: DataFrame, top: list, worth) -> int:
    """How many of ``top``, taken in their order, are the best at their turn."""
    place = F.broadcast(spark.createDataFrame([(r["session"], i) for i, r in enumerate(top)], "session string, place int"))
    marked = pairs.join(place, "session", "left")
    per_candidate = marked.groupBy("candidate").agg(
        F.sort_array(F.collect_list("place")).alias("p"), F.count("*").alias("left"), F.max(F.when(F.col("place").isNull(), F.col("session"))).alias("outside"), F.max_by("session", "place").alias("latest"),
    )
    n = F.size("p")
    # A candidate that lacks one session only, once the others of the list are taken, raises that session's value then.
    raised = per_candidate.select(
        F.when(n == F.col("left"), F.col("latest")).otherwise(F.col("outside")).alias("session"),
        F.when((n == F.col("left")) & (n >= 2), F.get("p", n - 2)).when((n + 1 == F.col("left")) & (n >= 1), F.get("p", n - 1)).alias("after"),
    ).where("after is not null")
    upto = Window.partitionBy("session").orderBy("after").rowsBetween(Window.unboundedPreceding, 0)
    raised = raised.groupBy("session", "after").agg(F.count("*").alias("more")).withColumn("more", F.sum("more").over(upto))
    grown = raised.join(per, "session").select("session", "after", worth(F.col("completes") + F.col("more"), F.col("partial")).alias("value"), "cost").join(place, "session", "left")
    listed = spark.createDataFrame([([tuple(r) for r in top],)], "listed array<struct<session:string,value:double,cost:double>>")
    better = lambda r: (r["value"] > F.col("value")) | (r["value"] == F.col("value")) & ((r["cost"] < F.col("cost")) | (r["cost"] == F.col("cost")) & (r["session"] < F.col("session")))
    turn = F.greatest(F.col("after") + 1, F.size(F.filter("listed", better)))
    found = grown.crossJoin(F.broadcast(listed)).withColumn("turn", turn).where(F.col("place").isNull() | (F.col("turn") < F.col("place")))  # one row
    first = found.agg(F.min("turn")).first()[0]
    return len(top) if first is None else min(first, len(top))
