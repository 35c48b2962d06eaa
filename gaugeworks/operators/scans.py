"""Scan collections: labels, relations, moves, removals, eligible environments and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mining, ranges


def object_labels(objects: DataFrame) -> DataFrame:
    """(scan, instance, label) of (scan, objects[{id, label}]); ids that are no numbers go."""
    rows = objects.select("scan", F.explode("objects").alias("o"))
    return rows.select("scan", F.col("o.id").try_cast("int").alias("instance"), F.col("o.label").alias("label")).where("instance is not null and label <> ''")


def named_relations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations (scan, subject, object, predicate) whose ends both have a label."""
    end = lambda side: labels.select("scan", F.col("instance").alias(side), F.col("label").alias(f"{side}_label"))
    return rows.join(end("subject"), ["scan", "subject"]).join(end("object"), ["scan", "object"])


def removals(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """(reference, scan, instance, label) of removed objects, named by the reference scan."""
    rows = scans.select("reference", F.explode("scans").alias("s")).select("reference", F.col("s.reference").alias("scan"), F.explode("s.removed").alias("instance"))
    return rows.join(labels.select(F.col("scan").alias("reference"), "instance", "label"), ["reference", "instance"]).select("reference", "scan", "instance", "label")


def named_moves(moves: DataFrame, labels: DataFrame) -> DataFrame:
    """Moves (reference, scan, instance, displacement) with the label of the reference scan."""
    return moves.join(labels.select(F.col("scan").alias("reference"), "instance", "label"), ["reference", "instance"])


def environments(scans: DataFrame) -> DataFrame:
    """(reference, split, n_sessions, withheld): the reference scan counts as a session; a move without a transform is withheld."""
    rescans = F.filter("scans", lambda s: s["reference"].isNotNull())
    withheld = F.exists(rescans, lambda s: F.exists(F.coalesce(s["rigid"], F.array().cast(scans.schema["scans"].dataType.elementType["rigid"].dataType)), lambda m: m.isNull() | m["transform"].isNull()))
    return scans.where("reference is not null").select("reference", F.coalesce("type", F.lit("unknown")).alias("split"), (F.size(rescans) + 1).alias("n_sessions"), F.coalesce(withheld, F.lit(False)).alias("withheld"))


def multi_session(envs: DataFrame, min_sessions: int = 2, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    return envs.where(F.col("split").isin(*splits) & (F.col("n_sessions") >= min_sessions) & ~F.col("withheld"))


def summary(envs: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: environments, sessions, moves, moves of loose objects, upper median displacement."""
    median = ranges.order_statistics(moves, "displacement", {"median": ranges.index_rank(1, 2)}).select(F.coalesce("median", F.lit(0.0)).alias("median_displacement"))
    loose = moves.agg(F.count("*").alias("moves"), F.count_if(~F.lower("label").isin(mining.STRUCTURAL)).alias("loose_moves"))
    return envs.agg(F.count("*").alias("environments"), F.coalesce(F.sum("n_sessions"), F.lit(0)).alias("scans")).crossJoin(loose).crossJoin(median)  # one row each


def scan_index(scans: DataFrame) -> DataFrame:
    """(reference, scan, index, n_rescans): the place of each later scan among those of its room, from 1."""
    rescans = F.filter("scans", lambda s: s["reference"].isNotNull())
    return scans.select("reference", F.size(rescans).alias("n_rescans"), F.posexplode(rescans).alias("i", "s")).select("reference", F.col("s.reference").alias("scan"), (F.col("i") + 1).alias("index"), "n_rescans")


def question(env_id: Column, label: Column, index: Column, n_rescans: Column) -> Column:
    """A relocation question; the room is named so that rooms do not share a text."""
    when = F.when(n_rescans == 1, "in the later scan").otherwise(F.concat(F.lit("in scan "), index.cast("string"), F.lit(" of the "), n_rescans.cast("string"), F.lit(" taken afterwards")))
    return F.concat(F.lit("In room "), F.left(env_id, F.lit(8)), F.lit(", the "), F.lower(label), F.lit(" was moved between scans. Which object was it closest to "), when, F.lit("?"))
