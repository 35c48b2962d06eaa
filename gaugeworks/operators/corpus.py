"""Corpus operations: projections, filters, resume and consistency."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_projection(items: DataFrame) -> DataFrame:
    """What a system under test may see of an item, and nothing else."""
    return items.select("item_id", "question", "answer_format", "options", F.col("answer_numeric.unit").alias("unit"))


def suite_filter(items: DataFrame, axes: Iterable[str] = (), env_ids: Iterable[str] = (), limit: int | None = None, order: str = "item_ord") -> DataFrame:
    """Axis filter, then environment filter, then the first rows by ``order``; an empty set filters nothing."""
    axes, env_ids = list(axes), list(env_ids)
    items = items.where(F.col("axis").isin(axes)) if axes else items
    items = items.where(F.col("env_id").isin(env_ids)) if env_ids else items
    return items.orderBy(order).limit(limit) if limit is not None else items


def suite_label(name: str, sha: str, axes: Iterable[str] = (), env_ids: Iterable[str] = (), limit: int | None = None) -> tuple[str, str]:
    """Name and hash of a filtered suite: both say so, and the hash is not computed anew."""
    parts = [f"{k}={','.join(sorted(v))}" for k, v in (("axes", axes), ("envs", env_ids)) if v] + ([f"limit={limit}"] if limit is not None else [])
    return (f"{name}[{';'.join(parts)}]", f"{sha}+filtered") if parts else (name, sha)


def envs_of(envs: DataFrame, items: DataFrame) -> DataFrame:
    return envs.join(items, "env_id", "left_semi")


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that no finished row covers."""
    return items.join(done.select(key), key, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti").select(key)


def prediction_rows(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with their answers, gold columns and cross-session flag, as the prediction log holds them."""
    gold = items.select(
        "item_id", "env_id", "axis", "answer_format", "question", "options", F.col("answer").alias("gold_answer"), F.col("answer_text").alias("gold_answer_text"),
        F.col("answer_numeric.value").alias("gold_answer_numeric"), F.col("answer_numeric.unit").alias("gold_unit"), "aliases", "evidence",
        "is_unanswerable", "abstention_option", F.col("certificate.cross_session").alias("cross_session"),
    )
    return gold.join(answers, "item_id")


def axis_counts(items: DataFrame, cross: Column) -> DataFrame:
    return items.groupBy("axis").agg(F.count("*").alias("n"), F.count_if(cross).alias("n_cross"))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(n_shared, n_mismatch): rows of both tables, and those that differ in any of the columns."""
    both = a.alias("a").join(b.alias("b"), key)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.agg(F.count("*").alias("n_shared"), F.count_if(~same).alias("n_mismatch"))


def permutation_check(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, ok): are the orders 0 to n - 1, each once?"""
    n = F.count("*")
    return rows.groupBy(group).agg(((F.min(order) == 0) & (F.max(order) == n - 1) & (F.countDistinct(order) == n)).alias("ok"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n_only_a, n_only_b, equal) on the distinct keys of both tables; null is a key like any other."""
    mark = lambda df, tag: df.select(key).distinct().withColumn("__side", F.lit(tag))
    sides = mark(a, "a").unionByName(mark(b, "b")).groupBy(key).agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"))
    out = sides.agg(F.count_if(F.col("hi") == "a").alias("n_only_a"), F.count_if(F.col("lo") == "b").alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def set_equal(a: DataFrame, b: DataFrame, key: str) -> bool:
    return set_difference(a, b, key).first()["equal"]


def top_share(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().agg((F.max("count") / F.sum("count")).alias("top_share"))


def round_robin(rows: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """The first n rows when categories take turns, each in its own order."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return rows.withColumn("rn", place).where(F.col("rn") <= n).orderBy("rn", category).limit(n)


def thin_evenly(rows: DataFrame, order: str, n: int, keep: int) -> DataFrame:
    """Of the first n rows by ``order``, those at floor(i * n / keep)."""
    first = rows.orderBy(order).limit(n)
    placed = first.withColumn("__at", F.row_number().over(Window.orderBy(order)) - 1)
    wanted = rows.sparkSession.range(min(keep, n)).select(F.col("id").cast("int").alias("i"), F.floor(F.col("id") * n / keep).cast("int").alias("__at"))
    return placed.join(F.broadcast(wanted), "__at").drop("__at")
