"""Mining questions from annotations, and auditing what was mined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import checkpointed
from . import ranges

#: Moves of an environment that are walked in one row; more than its 1,000 a limit by window would not be told before the shuffle.
WALKED = 256

#: Labels too general to name, and labels of the room itself.
UNUSABLE = "clutter object objects item items stuff wall floor ceiling room doorframe windowframe unknown other".split()
STRUCTURAL = ["wall", "floor", "ceiling", "door", "doorframe", "window", "windowframe", "stairs", "column", "beam", "ceiling light", "light", "heater", "radiator", "pipe", "wall frame", "floor mat", "carpet", "rug"]
#: Predicates of place, and those of nearness.
SPATIAL = ["close by", "left", "right", "front", "behind", "supported by", "standing on", "lying on", "hanging on", "attached to", "inside", "standing in", "lying in", "hanging in", "leaning against", "connected to", "build in"]
PROXIMITY = ["close by", "standing on", "lying on", "inside"]


def usable(label: Column) -> Column:
    return F.coalesce((label != "") & ~F.lower(label).isin(UNUSABLE), F.lit(False))


def moved_objects(moves: DataFrame, min_displacement: float) -> DataFrame:
    return moves.where(~F.lower("label").isin(STRUCTURAL) & (F.col("displacement") >= min_displacement))


def relations(rows: DataFrame, proximity_only: bool = False) -> DataFrame:
    return rows.where(F.lower("predicate").isin(PROXIMITY if proximity_only else SPATIAL))


def labelled(rows: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their label; rows without one go."""
    return rows.join(labels, on)


def article(label: Column) -> Column:
    return F.when(F.lower(F.left(label, F.lit(1))).isin(*"aeiou"), "an").otherwise("a")


def relocation_candidates(placements: DataFrame, min_places: int = 2, min_sessions: int = 1) -> DataFrame:
    """(participant, object, n_places, n_sessions): objects put in several places."""
    out = placements.groupBy("participant", "object").agg(F.countDistinct("place").alias("n_places"), F.countDistinct("session").alias("n_sessions"))
    return out.where((F.col("n_places") >= min_places) & (F.col("n_sessions") >= min_sessions))


def placements(narrations: DataFrame) -> DataFrame:
    """Narrations of placements with the place they name."""
    rows = narrations.where(text.is_placement(F.col("verb"))).withColumn("d", text.destination(F.col("narration"), F.col("verb")))
    return rows.where("d is not null").select("participant_id", "video_id", "narration_id", "noun", F.col("d.head").alias("head"), F.col("d.surface").alias("surface"), "start_timestamp")


def candidate_rows(placed: DataFrame) -> DataFrame:
    """Nested candidates: sessions, and by place the narrations that name it."""
    item = F.struct("video_id", "narration_id", "surface", "start_timestamp")
    places = placed.groupBy("participant_id", "noun", "head").agg(F.sort_array(F.collect_list(item)).alias("seen"), F.collect_set("video_id").alias("videos"))
    out = places.groupBy("participant_id", "noun").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("head", "seen")))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("videos")))).alias("sessions"), F.count("*").alias("n_places"))
    return out.where("n_places >= 2").withColumn("n_sessions", F.size("sessions")).withColumnRenamed("noun", "object")


def mine_environment(built: DataFrame, cap: int | None = 4) -> DataFrame:
    """Questions of each environment from buildable moves (env_id, ord, scan, subject, gold, displacement).

    Moves are taken by falling displacement, then ``ord``, one question for each subject; a question whose mirror
    (same scan, gold and subject exchanged) was asked is left out, labels compared in lower case; at most ``cap`` an
    environment, all of them for None.

    With a cap the walk mostly ends among an environment's first ``WALKED`` moves, which a limit by window tells before and
    after one shuffle by environment; these are folded in one row.  An environment that has more and is short of its cap then
    is mined in rounds (``_rounds``), as are all without a cap.
    """
    usable_ = built.where(usable(F.col("subject")) & usable(F.col("gold")))
    if cap is None or cap > WALKED:
        return _rounds(usable_, cap)
    walked = checkpointed(_walked(usable_, cap))
    short = (F.col("__n") == WALKED) & (F.size("__taken") < cap)
    taken = walked.where(~short).select(F.explode("__taken").alias("t")).select("t.*")
    left = walked.where(short).select("env_id")
    return taken if left.isEmpty() else taken.unionByName(_rounds(ranges.joined(usable_, left, ["env_id"], "left_semi"), cap))


def _order() -> list[Column]:
    """The order of the walk: falling displacement, those without one last."""
    return [F.coalesce(-F.col("displacement").cast("double"), F.lit(float("nan"))).alias("d"), *map(F.col, ("ord", "scan", "subject", "gold"))]


def _walked(rows: DataFrame, cap: int) -> DataFrame:
    """(env_id, __n, __taken): how many of an environment's first ``WALKED`` moves there are, and which of them the walk takes."""
    columns = rows.columns
    order = Window.partitionBy("env_id").orderBy(*_order(), *(c for c in columns if c not in ("env_id", "ord", "scan", "subject", "gold")))
    first = rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= WALKED)
    moves = first.groupBy("env_id").agg(F.sort_array(F.collect_list(F.struct("__k", F.struct(*columns).alias("row")))).alias("__moves"))
    low = lambda m, c: F.lower(m[c])
    mirror = lambda t, m: t["scan"].eqNullSafe(m["scan"]) & (low(t, "subject") == low(m, "gold")) & (low(t, "gold") == low(m, "subject"))
    blocked = lambda taken, m: F.exists(taken, lambda t: (low(t, "subject") == low(m, "subject")) | mirror(t, m))
    step = lambda taken, m: F.when((F.size(taken) >= cap) | blocked(taken, m["row"]), taken).otherwise(F.concat(taken, F.array(m["row"])))
    none = F.filter(F.transform("__moves", lambda m: m["row"]), lambda _: F.lit(False))
    return moves.select("env_id", F.size("__moves").alias("__n"), F.aggregate("__moves", none, step).alias("__taken"))


def _rounds(rows: DataFrame, cap: int | None) -> DataFrame:
    """The choice of the sequential walk, made in rounds over all environments at once.

    A move is blocked only by better moves of its subject or by its mirror, so each round accepts every subject's best open
    move whose mirror is not open and better, and drops what the accepted ones block.  An environment's best open move is
    always accepted, so after ``cap`` rounds the first ``cap`` of the walk are; without a cap rounds go on until no move is
    open.  Joins are by environment and labels, so one environment is spread over many tasks.
    """
    low = lambda c: F.lower(c)
    columns = rows.columns
    rows = rows.select("env_id", "scan", low("subject").alias("s"), low("gold").alias("g"), F.struct(*_order()).alias("at"), F.struct(*columns).alias("row"))
    # Of moves alike in scan and labels only the best can be taken.
    best = rows.groupBy("env_id", "scan", "s", "g").agg(F.min(F.struct("at", "row")).alias("m")).select("env_id", "scan", "s", "g", "m.at", "m.row")
    best = checkpointed(best)
    open_, taken = best.drop("row"), None
    left = cap
    while left is None or left > 0:
        heads = open_.groupBy("env_id", "s").agg(F.min(F.struct("at", "scan", "g")).alias("m")).select("env_id", "m.scan", "s", "m.g", "m.at")
        mirror = open_.select("env_id", "scan", F.col("s").alias("g"), F.col("g").alias("s"), F.col("at").alias("other"))
        accepted = ranges.joined(heads, mirror, ["env_id", "scan", "s", "g"]).where("other is null or s = g or at < other").drop("other")
        accepted = checkpointed(accepted)
        taken = accepted if taken is None else taken.unionByName(accepted)
        open_ = ranges.joined(open_, accepted.select("env_id", "s"), ["env_id", "s"], "left_anti")
        open_ = checkpointed(ranges.joined(open_, accepted.select("env_id", "scan", F.col("s").alias("g"), F.col("g").alias("s")), ["env_id", "scan", "s", "g"], "left_anti"))
        left = left - 1 if left is not None else None
        if open_.isEmpty():
            break
    if taken is None:
        return rows.select("row.*").limit(0)
    if cap is not None:
        place = F.row_number().over(Window.partitionBy("env_id").orderBy("at"))
        taken = taken.withColumn("place", place).where(F.col("place") <= cap).drop("place")
    return ranges.joined(taken.drop("at"), best.drop("at"), ["env_id", "scan", "s", "g"], "inner").select("row.*")


def guesser_ceiling(items: DataFrame, letter: str) -> DataFrame:
    """(best, share): the letter a constant guesser should choose, and what it would score."""
    per = items.groupBy(letter).count()
    total = per.agg(F.sum("count").alias("n"))
    return per.orderBy(F.desc("count"), letter).limit(1).crossJoin(total).select(F.col(letter).alias("best"), (F.col("count") / F.col("n")).alias("share"))


def reciprocal_pairs(questions: DataFrame, scan: str = "scan", subject: str = "subject", gold: str = "gold") -> DataFrame:
    """(a, b), a < b: two questions of one scan that answer each other."""
    x, y = questions.alias("x"), questions.alias("y")
    on = (F.col(f"x.{scan}") == F.col(f"y.{scan}")) & (F.col(f"x.{subject}") == F.col(f"y.{gold}")) & (F.col(f"x.{gold}") == F.col(f"y.{subject}")) & (F.col(f"x.{subject}") < F.col(f"y.{subject}"))
    return x.join(y, on).select(F.col(f"x.{subject}").alias("a"), F.col(f"x.{gold}").alias("b")).distinct()


def subject_of(question: Column) -> Column:
    """The subject of a relocation question, with or without a room before it."""
    return F.nullif(F.regexp_extract(question, r"(?i)(?:^|,\s*)the\s+(.+?)\s+was\s+moved", 1), F.lit(""))


def relocation_survey(placed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(participant, n_sessions, n_cross): recordings of each participant, and objects put in two places over two of them.

    ``placed`` has (participant, object, place, session), ``sessions`` (participant, session).
    """
    cross = relocation_candidates(placed, 2, 2).groupBy("participant").agg(F.count("*").alias("n_cross"))
    per = sessions.groupBy("participant").agg(F.countDistinct("session").alias("n_sessions"))
    return per.join(cross, "participant", "left").withColumn("n_cross", F.coalesce("n_cross", F.lit(0)))


def survey_totals(survey: DataFrame) -> DataFrame:
    """One row: participants, their median and largest number of sessions, objects in all."""
    told = survey.agg(F.count("*").alias("participants"), F.max("n_sessions").alias("max_sessions"), F.coalesce(F.sum("n_cross"), F.lit(0)).alias("n_cross"))
    return told.crossJoin(ranges.linear_percentiles(survey, "n_sessions", {"median_sessions": 0.5}))  # one row each


def second_nouns(rows: DataFrame, nouns: str, own: str, k: int = 20) -> DataFrame:
    """(noun, count): the nouns that stand most often beside a row's own noun, each once a row."""
    others = rows.select(F.explode(F.array_distinct(nouns)).alias("noun"), F.col(own).alias("__own")).where(~F.col("noun").eqNullSafe(F.col("__own")))
    return others.groupBy("noun").count().orderBy(F.desc("count"), "noun").limit(k)


def balanced(rows: DataFrame, key: str, letters: str = "ABCD", seed: int = 0) -> DataFrame:
    """Letters dealt in turn over rows in the order of a seeded hash; counts differ by one at most.

    Ranks come from counts of hash ranges, so no task sees all rows.
    """
    spread = rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__b", F.shiftright("__h", 54))
    sizes = spread.groupBy("__b").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__b", before.alias("__s"))  # 1024 rows at most
    place = F.col("__s") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    letter = F.element_at(F.array(*map(F.lit, letters)), (place % len(letters) + 1).cast("int"))
    return spread.join(F.broadcast(starts), "__b").withColumn("letter", letter).drop("__h", "__b", "__s")
