"""Vectors and positions: nearest neighbours, margins, similarity and means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a room of more is compared block by block.
BLOCK = 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def neighbours(points: DataFrame, scan: str, key: str, vector: str) -> DataFrame:
    """(scan, key, other, dist): each point's others in its scan; scans are rooms of tens of objects."""
    a, b = points.alias("a"), points.alias("b")
    both = a.join(b, (F.col(f"a.{scan}") == F.col(f"b.{scan}")) & (F.col(f"a.{key}") != F.col(f"b.{key}")))
    return both.select(F.col(f"a.{scan}").alias(scan), F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("other"), distance(F.col(f"a.{vector}"), F.col(f"b.{vector}")).alias("dist"))


def nearest(points: DataFrame, room: str, key: str, vector: str, k: int, by: str = "dist") -> DataFrame:
    """(key, other, dist or cos): pairs among which are each point's k nearest others of its whole room.

    Every block of a room meets every other one, and a meeting gives k pairs a point, so only two
    blocks are held at once; a point is sent twice as often as its room has blocks.  Cosines are rounded to nine places, and ties go to the smaller other;
    a zero vector's cosine is -2, so it comes last.  Null rooms, keys and vectors have no pairs.
    """
    rows = points.select(F.col(room).alias("room"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).dropna()
    blocks = rows.groupBy("room").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "room").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = dealt.select("room", F.col("own").alias("a"), each.alias("b"), F.lit(True).alias("asks"), "key", "v")
    asked = dealt.select("room", each.alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"), "key", "v")
    kind = rows.schema["key"].dataType.simpleString()

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        keys = table["key"].combine_chunks()
        codes = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        norm = np.sqrt((v * v).sum(axis=1))
        if by == "cos":
            v = v / np.where(norm > 0, norm, 1.0)[:, None]
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(x) if len(y) else 0, 256):
            q = x[at : at + 256]
            # Rounded differently from the pair by pair value below, hence the slack.
            if by == "cos":
                far, slack = -(v[q] @ v[y].T), 3e-9
                far[:, norm[y] == 0] = far[norm[q] == 0] = 2.0
            else:
                far = (norm[q] ** 2)[:, None] + norm[y] ** 2 - 2 * (v[q] @ v[y].T)
                slack = 1e-12 * (norm[q].max() ** 2 + norm[y].max() ** 2)
            far[codes[q][:, None] == codes[y]] = np.inf
            limit = np.partition(far, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            i, j = np.nonzero((far <= limit[:, None] + slack) & np.isfinite(far))
            i, j = q[i], y[j]
            value = np.empty(len(i))
            for p in range(0, len(i), 100_000):
                a, b = i[p : p + 100_000], j[p : p + 100_000]
                if by == "cos":
                    value[p : p + 100_000] = np.where((norm[a] > 0) & (norm[b] > 0), np.round((v[a] * v[b]).sum(axis=1), 9), -2.0)
                else:
                    value[p : p + 100_000] = np.sqrt(((v[a] - v[b]) ** 2).sum(axis=1))
            order = np.lexsort((codes[j], -value if by == "cos" else value, i))
            i, j, value = i[order], j[order], value[order]
            # The rank of a pair is its distance from the first one of its point.
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[top], j[top], value[top]))
        i, j, value = (np.concatenate(c) if c else np.zeros(0) for c in (list(zip(*found, strict=True)) or ((), (), ())))
        return pa.table({"key": keys.take(pa.array(i, pa.int64())), "other": keys.take(pa.array(j, pa.int64())), by: pa.array(value, pa.float64())})

    return asking.unionByName(asked).groupBy("room", "a", "b").applyInArrow(meet, f"key {kind}, other {kind}, {by} double").withColumnRenamed("key", key)


def nearest_with_margin(pairs: DataFrame, key: str) -> DataFrame:
    """(key, nn, dist, margin): the nearest other, and how much farther the next one is."""
    w = Window.partitionBy(key).orderBy("dist", "other")
    ranked = pairs.withColumns({"r": F.row_number().over(w), "margin": F.lead("dist").over(w) - F.col("dist")})
    return ranked.where("r = 1").select(key, F.col("other").alias("nn"), "dist", "margin")


def distinct_distractors(pairs: DataFrame, subject: str, label: str, gold: str, n: int = 3) -> DataFrame:
    """(subject, rank, label): the n nearest labels other than the gold one, each once."""
    least = pairs.where(F.col(label) != F.col(gold)).groupBy(subject, label).agg(F.min("dist").alias("dist"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy(subject).orderBy("dist", label)))
    return ranked.where(F.col("rank") <= n).select(subject, "rank", label)


def vector_mean(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, mean) of array components."""
    return rows.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def memory_state(chunks: DataFrame, by: str, vector: str, kind: str = "mean") -> DataFrame:
    """(by, memory, n_records, memory_bytes): what a substrate holds of the chunks it was given.

    ``mean`` holds the mean vector, 8 bytes a component; ``none`` takes chunks in and holds nothing (memory is null).
    """
    if kind == "none":
        return chunks.groupBy(by).agg(F.lit(None).cast("array<double>").alias("memory"), F.lit(0).cast("long").alias("n_records"), F.lit(0).cast("long").alias("memory_bytes"))
    if kind != "mean":
        raise ValueError(f"unknown substrate {kind!r}")
    held = vector_mean(chunks, by, vector).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"))  # one entry a component
    counts = chunks.groupBy(by).agg(F.count(vector).alias("n_records"))
    return counts.join(held, by, "left").select(by, F.transform("m", lambda x: x["mean"]).alias("memory"), "n_records", F.coalesce(8 * F.greatest(F.size("m"), F.lit(0)), F.lit(0)).cast("long").alias("memory_bytes"))


def calibrated_choice(query: Column, memory: Column, options: list[tuple[str, Column]]) -> Column:
    """The option whose similarity gains most from memory over the query alone; ties go to the first letter.

    Without memory (null) the query stands for it, so nothing gains.
    """
    memory = F.coalesce(memory, query)
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a value that is used often is computed once
    unit = lambda v: once(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))

    def best(both: Column) -> Column:
        scored = F.array(*(F.struct((dot(both["m"], o) - dot(both["q"], o)).alias("gain"), F.lit(-i).alias("i"), F.lit(letter).alias("letter")) for i, (letter, o) in enumerate(options)))
        return F.array_max(scored)["letter"]

    return once(F.struct(unit(memory).alias("m"), unit(query).alias("q")), best)
