"""Writers and merges: JSON lines, suites with checksums, and keyed upserts over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; null fields are written too."""
    df.write.option("ignoreNullFields", False).mode(mode).json(path)


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result in any format, all or nothing, and never over one that is there."""
    df.write.mode("errorifexists").format(kind).save(path)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def suite_sha(items_sha: Column, envs_sha: Column) -> Column:
    """Hash of both hashes; the order of lines matters, as it does for each of them."""
    return F.sha2(F.concat(items_sha, envs_sha), 256)


def write_suite(items: DataFrame, envs: DataFrame, folder: str) -> dict:
    """Write items and environments as a folder of ordered parts each and return the manifest's counts.

    The parts, by name, are the ordered lines, however many there are, so their joint hash does not depend on that.
    """
    for name, df, key in (("items", items, "item_id"), ("envs", envs, "env_id")):
        df.orderBy(key).write.option("ignoreNullFields", False).json(f"{folder}/{name}.jsonl")
    axes = {r["axis"]: r["count"] for r in items.groupBy("axis").count().orderBy("axis").collect()}
    return {"n_items": items.count(), "n_envs": envs.count(), "axes": axes}


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), latch: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: new rows overwrite old ones, but for columns that keep the first value or stay true once true."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    both = o.join(n, keys, "full")

    def column(c: str) -> Column:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_old:
            return F.coalesce(before, after).alias(c)
        if c in latch:
            return (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).alias(c)
        return F.when(F.col("n.__n"), after).otherwise(before).alias(c)

    return both.select(*keys, *(column(c) for c in old.columns if c not in keys))


def append_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; other keys add up."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "__new")


def reject_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The rows whose parent exists; raises when one has none."""
    orphan = rows.join(parents, key, "left_anti").select(key).first()
    if orphan:
        raise ValueError(f"{key} {orphan[key]} has no parent row")
    return rows


def cascade(rows: DataFrame, kept_parents: DataFrame, key: str) -> DataFrame:
    return rows.join(kept_parents, key, "left_semi")
