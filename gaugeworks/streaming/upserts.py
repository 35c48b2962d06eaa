"""A table of newest rows that a stream keeps, whose writes grow with the batch and not with the table.

Keys are dealt by hash into buckets.  Each batch adds a run of its newest rows to the buckets it touches, a
folder of Parquet files a batch.  A bucket's runs are merged from the newest on as long as the next older
run is at most twice as large, so a bucket has about log2(n) runs and a row is rewritten about
log2(n) times in all.  A batch's index, written last, names the runs of every bucket: readers and later batches
see a batch whole or not at all, and a batch that is run again writes the same folders anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import last_wins

BUCKETS = 64
Runs = dict[int, list[tuple[str, int]]]  # bucket -> (folder, rows), oldest first


def _index(spark: SparkSession, table: str, before: int | None = None) -> Runs:
    """The index of the newest finished batch, or of the newest before one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/index/epoch=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    epochs = [int(str(f.getPath().getParent().getName()).removeprefix("epoch=")) for f in found]
    epochs = [e for e in epochs if before is None or e < before]
    if not epochs:
        return {}
    told = spark.read.text(f"{table}/index/epoch={max(epochs)}", wholetext=True).first()["value"]
    return {int(b): [(folder, rows) for folder, rows in runs] for b, runs in json.loads(told).items()}


def _read(spark: SparkSession, table: str, runs: Runs) -> DataFrame | None:
    """The rows of runs with ``__bucket`` and ``__epoch``; a key may stand in several of them."""
    folders: dict[str, list[int]] = {}
    for bucket, own in runs.items():
        for folder, _ in own:
            folders.setdefault(folder, []).append(bucket)
    out = None
    for folder, buckets in sorted(folders.items()):
        part = spark.read.parquet(f"{table}/{folder}").where(F.col("__bucket").isin(buckets))
        out = part if out is None else out.unionByName(part)
    return out


def _write(rows: DataFrame, table: str, folder: str) -> dict[int, int]:
    """Write rows by bucket and count them."""
    rows.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{table}/{folder}")
    return {r["__bucket"]: r["count"] for r in rows.sparkSession.read.parquet(f"{table}/{folder}").groupBy("__bucket").count().collect()}


def upsert(batch: DataFrame, epoch: int, table: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Add a batch's newest rows, by ``order``, to the table; ``order`` only decides within a batch."""
    spark = batch.sparkSession
    index = _index(spark, table, epoch)
    newest = last_wins(batch, keys, order).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("__epoch", F.lit(epoch).cast("long"))
    merged: Runs = {}
    for bucket, rows in _write(newest, table, f"added/epoch={epoch}").items():
        runs = index.setdefault(bucket, [])
        runs.append((f"added/epoch={epoch}", rows))
        total, keep = rows, len(runs) - 1
        while keep and runs[keep - 1][1] <= 2 * total:
            keep -= 1
            total += runs[keep][1]
        if keep < len(runs) - 1:
            merged[bucket] = runs[keep:]
            index[bucket] = runs[:keep]
    if merged:
        rows = last_wins(_read(spark, table, merged), [*keys, "__bucket"], "__epoch")
        for bucket, n in _write(rows, table, f"merged/epoch={epoch}").items():
            index[bucket].append((f"merged/epoch={epoch}", n))
    told = spark.createDataFrame([(json.dumps(index),)], "value string")
    told.coalesce(1).write.mode("overwrite").text(f"{table}/index/epoch={epoch}")


def read(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The newest row of each key as of the last finished batch."""
    runs = _index(spark, table)
    if not runs:
        raise ValueError(f"{table} has no finished batch")
    return last_wins(_read(spark, table, runs), [*keys, "__bucket"], "__epoch").drop("__bucket", "__epoch")


def follow(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("run_id", "item_id"), order: str = "created_at") -> StreamingQuery:
    """Keep the newest row of each key of a stream in a table; batches that are run again change nothing."""
    work = lambda batch, epoch: upsert(batch, epoch, table, list(keys), order)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
